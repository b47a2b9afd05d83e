"""Per-key results over keys of any weight.

Rows are range-partitioned on (key, secondary order, tie-breaker). Spark places
the range bounds at sampled quantiles of the *composite* key, so a key that
holds a third of the rows spans a third of the partitions. Every partition then
walks its rows in order and emits one partial state per key; a key cut by a
partition border has several states, which are stitched in partition order.
Only partial states take part in the second shuffle.

This gives order-dependent results (longest silence between two observations),
which map-side combining alone cannot.

Edge cases: a null key is a key of its own; rows with a null order value count
but take no part in first, last and gap; ties are gaps of zero; empty input
gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelake.session import Scratch, shuffle_partitions

_STATE = "key_value string, part int, n bigint, first_us bigint, last_us bigint, gap_us bigint"
_FIELDS = pa.schema([("key_value", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("gap_us", pa.int64())])


def _runs(batch: pa.RecordBatch) -> list[list]:
    """Columns key, n, first, last, gap of the runs of equal keys in one sorted batch."""
    rows = batch.num_rows
    codes = pc.fill_null(batch.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    known = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
    at = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    ends = np.r_[starts[1:], rows]
    # nulls sort first within a key, so the known values of a run are its tail
    heads = ends - np.add.reduceat(known.astype(np.int64), starts)
    gaps = np.zeros(rows, dtype=np.int64)
    gaps[1:] = at[1:] - at[:-1]
    gaps[heads[heads < rows]] = 0
    gaps[starts] = 0
    gaps[~known] = 0
    empty = heads == ends
    return [
        batch.column(0).take(pa.array(starts)).to_pylist(),
        (ends - starts).tolist(),
        pa.array(at[np.minimum(heads, rows - 1)], mask=empty).to_pylist(),
        pa.array(at[ends - 1], mask=empty).to_pylist(),
        pa.array(np.maximum.reduceat(gaps, starts), mask=empty).to_pylist(),
    ]


def _stitch(a: list, b: list) -> list:
    """One state of two adjacent states of one key."""
    key, n, first, last, gap = a
    if b[2] is not None:
        gap = max(gap, b[4], b[2] - last) if last is not None else b[4]
        first, last = b[2] if first is None else first, b[3]
    return [key, n + b[1], first, last, gap]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of one sorted partition; the run that a batch leaves open is carried into the next."""
    part, open_run = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = _runs(batch)
        if open_run is not None:
            if open_run[0] == runs[0][0]:
                for column, value in zip(runs, _stitch(open_run, [c[0] for c in runs])):
                    column[0] = value
            else:
                for column, value in zip(runs, open_run):
                    column.insert(0, value)
        open_run = [c.pop() for c in runs]
        if runs[0]:
            yield _batch(runs, part)
    if open_run is not None:
        yield _batch([[v] for v in open_run], part)


def _batch(runs: list[list], part: int) -> pa.RecordBatch:
    key, *rest = runs
    return pa.RecordBatch.from_pydict(dict(zip(_FIELDS.names, [key, [part] * len(key), *rest])), schema=_FIELDS)


def key_states(df: DataFrame, key: str, order: str, tie: str, partitions: int | None = None) -> DataFrame:
    """``key_value, n, first_us, last_us, max_gap_us`` per distinct ``key``, order given by timestamp ``order``."""
    partitions = partitions or shuffle_partitions(df.sparkSession)
    rows = df.select(
        F.col(key).cast("string").alias("k"),
        F.unix_micros(F.col(order).cast("timestamp")).alias("us"),
        F.col(tie).cast("long").alias("tie"),
    )
    ordered = rows.repartitionByRange(partitions, "k", "us", "tie").sortWithinPartitions("k", "us", "tie").select("k", "us")
    partial = ordered.mapInArrow(_states, _STATE)
    line = Window.partitionBy("key_value").orderBy("part")
    before = F.last("last_us", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    stitched = partial.withColumn("gap_us", F.greatest("gap_us", F.col("first_us") - before))
    return stitched.groupBy("key_value").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("gap_us").alias("max_gap_us")
    )


def heavy_keys(states: DataFrame, share: float) -> DataFrame:
    """Keys holding more than ``share`` of all rows; ``states`` comes from :func:`key_states`. A null key is never reported.

    The states are staged, since their total (one number, known only after they exist) is read before they are filtered.
    """
    staged = Scratch(states.sparkSession, "skew").stage(states.select("key_value", "n"), "states")
    total = staged.agg(F.sum("n")).first()[0] or 0
    return staged.where((F.col("n") > F.lit(total * share)) & F.col("key_value").isNotNull())
