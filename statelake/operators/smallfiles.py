"""Consolidating millions of tiny files.

Three steps, each usable alone:

* ``live_files`` replays the log of add and remove actions.
* ``plan`` assigns the small live files of each ``(shard, bucket, origin)`` to
  bins of about the target size. The number of bins follows from the group's
  total, and a file's bin from a hash of its number, so no group is ever
  gathered in one task, even if it holds a third of all files.
* ``compact_files`` copies the encoded column chunks of each bin into one larger
  file (:mod:`parquet_blocks`), without decoding a page, and validates the
  result: equal schemas, blocks taken up = blocks of the inputs, rows in = rows
  out and as the log states them, read again by an independent parquet reader.
  The copying task opens the files itself, so only their paths are shuffled.
  Output names derive from the bin and the schema, so a repeated task overwrites
  its own file, and the new file appears by one rename. The returned report is
  the basis of one atomic log commit.

``compact_rows`` is the same for files that exist only as rows of a table: the
copying task forms each file's image from its rows and copies that.

Edge cases: a file number whose newest actions contradict each other is live if
one of them is ``add`` and none is ``remove``; files without actions are not
live; null sizes are not small; null partition values form a group of their own;
repeated actions count once; a bin whose files have different schemas gives one
file per schema; a planned file without any row is copied as an empty one; empty
logs give empty plans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelake.operators.parquet_blocks import BlockCopier, schema_of
from statelake.session import Scratch
from statelake.sources.blobs import Store

SMALL_BYTES = 16384
TARGET_BYTES = 128 << 20
MAX_FILES = 2000
GROUP = ["shard", "bucket", "origin"]

REPORT = "bin string, file_no bigint, rows bigint, out_path string, out_bytes bigint"
_REPORT = pa.schema([("bin", pa.string()), ("file_no", pa.int64()), ("rows", pa.int64()), ("out_path", pa.string()), ("out_bytes", pa.int64())])

#: bin, file number, rows that the log states (or ``None``), image
Images = Iterator[tuple[str, int, int | None, bytes]]


def live_files(actions: DataFrame) -> DataFrame:
    """``file_no, shard, bucket, origin, size_bytes, num_rows`` of each file whose newest actions all are ``add``."""
    known = actions.where("file_no is not null")
    state = known.groupBy("file_no").agg(
        F.max("table_version").alias("added_or_removed"),
        F.max(F.when(F.col("action") != "add", F.col("table_version"))).alias("removed"),
        F.max(F.when(F.col("action") == "add", F.struct("table_version", *GROUP, "size_bytes", "num_rows"))).alias("a"),
    )
    newest = F.col("a").isNotNull() & (F.col("a.table_version") == F.col("added_or_removed")) & (F.col("removed").isNull() | (F.col("removed") < F.col("added_or_removed")))
    return state.where(newest).select("file_no", *[f"a.{c}" for c in GROUP], "a.size_bytes", "a.num_rows")


def small_files(actions: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    return live_files(actions).where(F.col("size_bytes") < small_bytes)


def group_bins(small: DataFrame, target_bytes: int = TARGET_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """The groups with at least two small files and how many bins each is to have (``g_shard``, ``g_bucket``, ``g_origin``, ``bins``): a row per partition of the table."""
    totals = small.groupBy(*[F.col(c).alias(f"g_{c}") for c in GROUP]).agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).where("files > 1")
    return totals.withColumn("bins", F.greatest(F.ceil(F.col("bytes") / target_bytes), F.ceil(F.col("files") / max_files)).cast("long"))


def assign(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """``rows`` (files, or rows of files) of the groups in ``bins``, with the ``bin`` of their ``file_no``."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in GROUP])
    number = F.pmod(F.xxhash64(F.col("file_no").cast("long")), F.col("bins"))
    name = F.sha1(F.to_json(F.struct(*GROUP, number.alias("bin"))))
    return rows.join(bins, same).withColumn("bin", name).drop(*bins.columns)


def plan(actions: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """``bin, file_no, shard, bucket, origin, size_bytes, num_rows`` of each file to be consolidated.

    These are the live files under ``small_bytes`` that have at least one such neighbour in their group.
    """
    small = small_files(actions, small_bytes)
    return assign(small, group_bins(small, target_bytes, max_files)).select("bin", "file_no", *GROUP, "size_bytes", "num_rows")


def _publish(copier: BlockCopier, name: str, folder: str) -> tuple[str, int]:
    """Write, check with an independent reader, then rename into place."""
    image = copier.finish()
    meta = pq.read_metadata(pa.BufferReader(image))
    if meta.num_rows != copier.rows or meta.num_row_groups != len(copier.groups):
        raise ValueError(f"{name}: {meta.num_rows} rows in {meta.num_row_groups} groups, expected {copier.rows} in {len(copier.groups)}")
    Store(folder).put(f"{name}.parquet", image)
    return f"{name}.parquet", len(image)


class _Bin:
    """The copy of one bin under way: a copier and its files per schema."""

    def __init__(self, name: str):
        self.name = name
        self.parts: dict[bytes, tuple[BlockCopier, list[int], list[int]]] = {}

    def add(self, number: int, expected: int | None, image: bytes) -> None:
        schema = schema_of(image)
        if schema not in self.parts:
            self.parts[schema] = (BlockCopier(), [], [])
        copier, numbers, rows = self.parts[schema]
        got = copier.add(image)
        if expected is not None and expected != got:
            raise ValueError(f"file {number}: the log says {expected} rows, the file holds {got}")
        numbers.append(number)
        rows.append(got)

    def close(self, folder: str) -> Iterator[pa.RecordBatch]:
        for schema, (copier, numbers, rows) in self.parts.items():
            path, size = _publish(copier, f"{self.name}-{hashlib.sha1(schema).hexdigest()[:8]}", folder)
            n = len(numbers)
            yield pa.RecordBatch.from_pydict({"bin": [self.name] * n, "file_no": numbers, "rows": rows, "out_path": [path] * n, "out_bytes": [size] * n}, schema=_REPORT)


def _copy(images: Images, folder: str) -> Iterator[pa.RecordBatch]:
    """Copy images sorted by bin, one bin at a time; one report row per input file."""
    bin_ = None
    for name, number, expected, image in images:
        if bin_ is None or name != bin_.name:
            if bin_ is not None:
                yield from bin_.close(folder)
            bin_ = _Bin(name)
        bin_.add(number, expected, image)
    if bin_ is not None:
        yield from bin_.close(folder)


def _copier(folder: str, images: Callable[[Iterator[pa.RecordBatch]], Images]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _copy(images(batches), folder)

    return run


def _opened(source: str):
    """Images of the files named by batches of ``bin, file_no, num_rows, path``, opened one after the other."""

    def images(batches: Iterator[pa.RecordBatch]) -> Images:
        files = Store(source)
        for batch in batches:
            for name, number, expected, path in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                yield name, number, expected, files.read(path)

    return images


def compact_files(planned: DataFrame, source: str, folder: str, partitions: int) -> DataFrame:
    """Copy the files of a plan (``bin, file_no, num_rows, path``; paths relative to ``source``) into one file per bin and schema below ``folder``.

    Returns ``REPORT`` rows, ``out_path`` relative to ``folder``. A bin is bounded by ``TARGET_BYTES`` and ``MAX_FILES``, and a task holds
    one bin at a time.
    """
    placed = planned.select("bin", F.col("file_no").cast("long"), F.col("num_rows").cast("long"), "path").repartition(partitions, "bin").sortWithinPartitions("bin", "file_no")
    return placed.mapInArrow(_copier(folder, _opened(source)), REPORT)


def _encode(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink, compression="snappy", use_dictionary=False, write_statistics=False, store_schema=False)
    return sink.getvalue().to_pybytes()


def _formed(columns: list[str]):
    """Images of the planned files among rows sorted by bin and file: bin, file, stated rows, a mark of real rows, then the file's own ``columns``.

    The first row of a planned file is its plan entry, without the mark; rows of other files are passed over. A file may span
    batches; only its own rows are held.
    """

    def image(parts: list[pa.Table]) -> bytes:
        rows = parts[0] if len(parts) == 1 else pa.concat_tables(parts).combine_chunks()
        return _encode(rows.rename_columns(columns))

    def images(batches: Iterator[pa.RecordBatch]) -> Images:
        held: list[pa.Table] = []
        open_: tuple[str, int] | None = None
        wanted, expected = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, numbers, stated, entries = batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(3).is_null().to_numpy(zero_copy_only=False)
            table = pa.Table.from_batches([batch]).select(range(4, batch.num_columns))
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])  # a file lies in one bin only
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)]):
                here = (names[lo].as_py(), int(numbers[lo]))
                if open_ != here:
                    if wanted:
                        yield *open_, expected, image(held)
                    held = []
                    open_, wanted, expected = here, bool(entries[lo]), stated[lo].as_py()
                    lo += entries[lo]
                    if wanted:
                        held.append(table.slice(lo, hi - lo))
                elif wanted:
                    held.append(table.slice(lo, hi - lo))
        if wanted:
            yield *open_, expected, image(held)

    return images


def compact_rows(actions: DataFrame, rows: DataFrame, folder: str, partitions: int, scratch: Scratch, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """As :func:`compact_files`, for small files whose rows are those of ``rows`` with their ``file_no``; they stand in for files that exist only as a listing.

    Rows name their group, and groups are few, so a row learns its bin without a shuffle. Rows and plan entries then meet in the one
    shuffle that brings bins together; images are formed where they are copied and never shuffled. In the end the rows copied of
    each file are compared with the rows of the table; a difference stops the run.
    """
    small = small_files(actions, small_bytes)
    bins = scratch.stage(group_bins(small, target_bytes, max_files).drop("bytes", "files"), "bins")
    own = [c for c in rows.columns if c.lower() != "file_no"]
    named = rows.where("file_no is not null").select(F.col("file_no").cast("long").alias("file_no"), *GROUP, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    content = assign(named, bins).select("bin", "file_no", F.lit(None).cast("long").alias("num_rows"), F.lit(True).alias("here"), *[f"c{i}" for i in range(len(own))])
    entries = assign(small, bins).select("bin", F.col("file_no").cast("long").alias("file_no"), F.col("num_rows").cast("long").alias("num_rows"))
    both = content.unionByName(entries, allowMissingColumns=True)
    placed = both.repartition(partitions, "bin").sortWithinPartitions("bin", "file_no", F.col("here").asc_nulls_first())
    report = scratch.stage(placed.mapInArrow(_copier(folder, _formed(own)), REPORT), "report")
    held = rows.where("file_no is not null").groupBy(F.col("file_no").cast("long").alias("file_no")).agg(F.count(F.lit(1)).alias("held"))
    # rows that name another group than their file's log entry would have gone elsewhere
    checked = report.join(held, "file_no", "left").withColumn("ok", F.assert_true(F.col("rows") == F.coalesce("held", F.lit(0)), F.concat(F.lit("not all rows were copied of file "), "file_no")))
    return checked.where("ok is null").drop("held", "ok")
