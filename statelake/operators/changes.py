"""Current state of a table from a change feed that arrives repeated and out of order.

Newest-first resolution: the feed is cut into batches by ``last_seen`` (bounds
at approximate quantiles of the feed), and the batches are processed backwards.
In each batch the newest image of every key is taken; keys that a newer batch
has already resolved are removed by an anti join. A resolved key is never
touched again, so each key is compared only within the batch that settles it.
What is left of the base table at the end is appended untouched.

Supersession groups (``origin, entity_id, prop, fragment``) are resolved by the
same walk; a fragment's image survives only if it is as new as its group.

Skew: images are picked by a max-aggregate with map-side combine, so one key
with a third of all changes costs one row per task.

Edge cases: null ``last_seen`` is older than everything; on equal ``last_seen``
a tombstone wins; null ``fragment`` is ``''``; null ids, origins, props compare
equal to null; remaining ties (same ``last_seen``, same liveness) are settled by
the largest remaining columns, so repeated rows give one row; empty feeds leave
the base as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelake.session import Scratch, shuffle_partitions

KEY = ["id", "origin", "fragment"]
GROUP = ["origin", "entity_id", "prop", "fragment"]
IMAGE = ["id", "origin", "fragment", "entity_id", "prop", "value", "first_seen", "last_seen", "deleted_at"]
BATCHES = 5


def normalised(df: DataFrame) -> DataFrame:
    """The image columns with a fragment that is never null, plus ``__us``, the order of change."""
    return df.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "fragment" else F.col(c) for c in IMAGE],
        F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(-(2**62))).alias("__us"),
        F.col("deleted_at").isNotNull().alias("__dead"),
    )


def batch_bounds(df: DataFrame, batches: int) -> list[int]:
    """Descending lower bounds of the batches; the oldest batch is open below."""
    shares = [1 - (i + 1) / batches for i in range(batches - 1)]
    found = df.agg(F.percentile_approx("__us", shares, 1000)).first()[0] or []
    return sorted(set(found), reverse=True)


def newest_first(staged: DataFrame, key: list[str], image: list[str], bounds: list[int], scratch: Scratch) -> DataFrame:
    """The newest image per ``key``: walk the batches from new to old, skip what is resolved.

    ``staged`` has the batch number in ``__batch`` (0 is the newest), as a partition column, so that each step reads its batch only.
    """
    resolved: list[DataFrame] = []
    order = F.struct("__us", "__dead", *[c for c in image if c not in ("__us", "__dead", *key)])
    for number in range(len(bounds) + 1):
        batch = staged.where(F.col("__batch") == number)
        images = batch.groupBy(*key).agg(F.max(order).alias("__image"))
        if resolved:
            known = reduce(DataFrame.unionByName, [r.select(*key) for r in resolved])
            same = reduce(lambda a, b: a & b, [images[c].eqNullSafe(known[c]) for c in key])
            images = images.join(known, same, "left_anti")
        resolved.append(scratch.stage(images.select(*key, "__image.*"), f"resolved{number}"))
    return reduce(DataFrame.unionByName, resolved)


def apply_changes(changes: DataFrame, base: DataFrame | None = None, batches: int = BATCHES) -> DataFrame:
    """Live rows (``IMAGE`` columns) after all ``changes`` have been applied to ``base``."""
    spark = changes.sparkSession
    scratch = Scratch(spark, "changes")
    rows = normalised(changes)
    bounds = batch_bounds(rows, batches)
    number = reduce(lambda rest, i: F.when(F.col("__us") >= bounds[i], i).otherwise(rest), reversed(range(len(bounds))), F.lit(len(bounds)))
    parts = max(1, shuffle_partitions(spark) // 4)
    staged = scratch.stage(rows.withColumn("__batch", number.cast("int")).repartition(parts * (len(bounds) + 1), "__batch", F.xxhash64("id") % parts), "batches", ["__batch"])
    images = newest_first(staged, KEY, [*IMAGE, "__us", "__dead"], bounds, scratch)
    groups = newest_first(staged.where("fragment <> ''"), GROUP, ["__us", "__dead"], bounds, scratch).select(*GROUP, F.col("__us").alias("__newest"))
    if base is not None:
        old = normalised(base)
        known = images.select(*KEY)
        untouched = old.join(known, reduce(lambda a, b: a & b, [old[c].eqNullSafe(known[c]) for c in KEY]), "left_anti")
        images = images.unionByName(untouched.select(images.columns))
        groups = groups.unionByName(old.where("fragment <> ''").groupBy(*GROUP).agg(F.max("__us").alias("__newest"))).groupBy(*GROUP).agg(F.max("__newest").alias("__newest"))
    live = images.where("not __dead")
    plain = live.where("fragment = ''")
    fragments = live.where("fragment <> ''").alias("i")
    same = reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"g.{c}")) for c in GROUP])
    newest = fragments.join(groups.alias("g"), same & (F.col("i.__us") == F.col("g.__newest")), "left_semi")
    return plain.unionByName(newest).select(*IMAGE)
