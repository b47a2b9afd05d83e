"""The merge: from an append log to canonical state.

Within a partition ``(shard, bucket, origin)``

* rows of one content (same id, entity, property, fragment) become one: the
  newest, a tombstone winning a tie, with the smallest ``first_seen`` of all;
* a fragment's rows survive only if they are as new as the newest row of their
  supersession group (entity, property, fragment); each keeps the ``first_seen``
  of its own content;
* tombstones at or before the grace cutoff disappear.

It is made of aggregates and not of windows: the content aggregate combines on
the map side and is keyed by statement id, so an entity with a third of all rows
is spread over all tasks. Only fragment rows take part in the group join.

A statement id is a hash over entity and property, so it determines both.

Edge cases: null ``last_seen`` is oldest; null ``fragment`` is ``''``; nulls in
other key columns equal each other; full ties are settled by the remaining
columns, so the result does not depend on row order; merging twice changes nothing.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelake.schema import NAMES

CONTENT = ["shard", "bucket", "origin", "entity_id", "fragment", "prop", "id"]
GROUP = CONTENT[:-1]
SORT = ["entity_id", "fragment", "prop", "id", "last_seen"]
SAMPLE = 10_000
TIES = ["last_seen", "deleted_at", "original_value", "lang", "prop_type", "source", "value", "schema", "dataset", "external"]


def merge(raw: DataFrame, cutoff: datetime | str | None = None) -> DataFrame:
    """Canonical rows of ``raw``. Tombstones not newer than ``cutoff`` are dropped; without a cutoff all are kept."""
    rows = raw.select(*NAMES).withColumn("fragment", F.coalesce("fragment", F.lit("")))
    content = rows.groupBy(*CONTENT).agg(F.min("first_seen").alias("first_seen"), F.max(F.struct(*TIES)).alias("newest"))
    content = content.select(*CONTENT, "first_seen", "newest.*")
    plain = content.where("fragment = ''")
    fragments = content.where("fragment <> ''").alias("f")
    newest = rows.where("fragment <> ''").groupBy(*GROUP).agg(F.max("last_seen").alias("last_seen")).alias("g")
    same = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*GROUP, "last_seen"]])
    merged = plain.unionByName(fragments.join(newest, same, "left_semi")).select(*NAMES)
    return reap(merged, cutoff)


def reap(rows: DataFrame, cutoff: datetime | str | None) -> DataFrame:
    """Without the tombstones that are not newer than ``cutoff``."""
    if cutoff is None:
        return rows
    limit = F.lit(cutoff).cast(rows.schema["deleted_at"].dataType)
    return rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") > limit))


def merge_by_windows(raw: DataFrame, cutoff: datetime | str | None = None) -> DataFrame:
    """The same result in two window branches; the specification that :func:`merge` is tested against."""
    rows = raw.select(*NAMES).withColumn("fragment", F.coalesce("fragment", F.lit("")))
    order = [F.col(c).desc_nulls_last() for c in TIES]
    a_key = Window.partitionBy("shard", "bucket", "origin", "id")
    b_group = Window.partitionBy("shard", "bucket", "origin", "entity_id", "prop", "fragment")
    b_key = Window.partitionBy("shard", "bucket", "origin", "entity_id", "prop", "fragment", "id")
    a = rows.where("fragment = ''").withColumn("lo", F.min("first_seen").over(a_key)).withColumn("rn", F.row_number().over(a_key.orderBy(*order))).where("rn = 1")
    b = (
        rows.where("fragment <> ''")
        .withColumn("lo", F.min("first_seen").over(b_key))
        .withColumn("mx", F.max("last_seen").over(b_group))
        .withColumn("rn", F.row_number().over(b_key.orderBy(*order)))
        .where("rn = 1 AND last_seen <=> mx")
        .drop("mx")
    )
    return reap(a.unionByName(b).withColumn("first_seen", F.col("lo")).select(*NAMES), cutoff)


def sorted_for_files(merged: DataFrame) -> DataFrame:
    """The order inside each file, for min/max statistics."""
    return merged.sortWithinPartitions("shard", "bucket", "origin", *SORT[:-1], F.col("last_seen").desc())


def slice_ranges(ids: list[str], slices: int) -> list[tuple[str | None, str | None]]:
    """Half-open ranges at the rank quantiles of a sample of ids; equal bounds collapse; together they tile the key space."""
    ordered = sorted(i for i in ids if i is not None)
    bounds = sorted({ordered[len(ordered) * k // slices] for k in range(1, slices)}) if ordered and slices > 1 else []
    if ordered and bounds and bounds[0] == ordered[0]:
        bounds = bounds[1:]
    edges = [None, *bounds, None]
    return list(zip(edges[:-1], edges[1:]))


def slice_count(partition_bytes: int, memory: int | str, factor: int = 32, fallback: int = 8 * 10**9) -> int:
    """Slices that keep a partition of this compressed size within ``memory``."""
    from statelake.functions.values import parse_byte_size

    try:
        budget = parse_byte_size(memory)
    except ValueError:
        budget = fallback
    return max(1, -(-partition_bytes * factor // max(1, budget)))


def merge_range(raw: DataFrame, lo: str | None, hi: str | None, cutoff: datetime | str | None = None) -> DataFrame:
    """The merge of the entities in ``[lo, hi)``, in the first range also of null ids; the ranges of :func:`slice_ranges` together give the whole merge."""
    rows = raw
    if lo is not None:
        rows = rows.where(F.col("entity_id") >= lo)
    if hi is not None:
        below = F.col("entity_id") < hi
        rows = rows.where(below if lo is not None else below | F.col("entity_id").isNull())
    return merge(rows, cutoff)


def sampled_ranges(raw: DataFrame, slices: int, size: int = SAMPLE) -> list[tuple[str | None, str | None]]:
    """:func:`slice_ranges` over a sample of about ``size`` of the table's ids, which is all that the driver receives."""
    ids = raw.where("entity_id is not null").select("entity_id")
    share = min(1.0, size / max(1, ids.count()))
    return slice_ranges([r[0] for r in (ids.sample(share, seed=0) if share < 1 else ids).collect()], slices)


def merge_sliced(raw: DataFrame, slices: int, cutoff: datetime | str | None = None) -> DataFrame:
    """The merge, one range of entities after the other, with bounds taken from the table."""
    return reduce(DataFrame.unionByName, [merge_range(raw, lo, hi, cutoff) for lo, hi in sampled_ranges(raw, slices)])


def last_wins(rows: DataFrame, sequence: str) -> DataFrame:
    """One row per ``(id, origin, fragment)`` of a batch: the last by ``sequence``."""
    others = [F.col(c) for c in rows.columns if c != sequence]
    best = rows.groupBy("id", "origin", "fragment").agg(F.max_by(F.struct(*others), F.col(sequence)).alias("r"))
    return best.select("r.*")
