"""As-of join: with each row the latest row of another table that has the same key and is not younger.

Rows are grouped by key *and* time bucket. Inside a bucket the match is the last
right row seen so far; where the bucket has none yet, it is the newest right row
of an earlier bucket, which comes from one aggregate row per key and bucket. So a
key with a third of all rows is spread over its buckets, and only bucket
summaries of a key (their number follows from the time span, not from the data)
are ever ordered together.

Edge cases: rows whose key or time is null match nothing and are kept; of right
rows with one key and time the one with the greatest remaining columns counts;
right rows with a null key or time are ignored; repeated left rows stay repeated;
an empty side gives no match or no row. Columns of the right side come as one
struct, so equal names do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 24 * 3600


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, name: str = "matched", bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``left`` with the struct column ``name``: the right row of the same ``key`` with the greatest ``right_time`` at or before ``left_time``, or null."""
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    bucket = F.floor(F.col("t") / (bucket_seconds * 1_000_000)).alias("b")
    others = [c for c in right.columns if c not in (key, right_time)]
    kept = F.struct(*[F.col(f"`{c}`") for c in (right_time, *others)])
    # one right row per key and time
    r = right.select(F.col(f"`{key}`").alias("k"), micros(right_time).alias("t"), kept.alias("r")).where("k is not null and t is not null")
    r = r.groupBy("k", "t").agg(F.max("r").alias("r")).select("k", "t", bucket, "r")
    l = left.select(F.col(f"`{key}`").alias("k"), micros(left_time).alias("t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"))
    whole = l.where("k is not null and t is not null").select("k", "t", bucket, "l")
    last = r.groupBy("k", "b").agg(F.max_by("r", "t").alias("last"))
    spots = last.unionByName(whole.select("k", "b").distinct(), allowMissingColumns=True).groupBy("k", "b").agg(F.max("last").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    carried = spots.select("k", "b", before.alias("carried")).where("carried is not null")
    both = r.unionByName(whole, allowMissingColumns=True)
    # at one time the right row comes first
    seen = F.last("r", ignorenulls=True).over(Window.partitionBy("k", "b").orderBy("t", F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    inside = both.select("k", "b", "l", seen.alias("seen")).where("l is not null")
    joined = inside.join(carried, ["k", "b"], "left").select("l.*", F.coalesce("seen", "carried").alias(name))
    alone = l.where("k is null or t is null").select("l.*", F.lit(None).cast(joined.schema[name].dataType).alias(name))
    return joined.unionByName(alone)
