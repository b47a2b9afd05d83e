"""Text exports in parts, plain, gzip or zstd, and reading them back.

Spark's own text writers know gzip but zstd only with a native library, so zstd
parts are written and read by the tasks with Arrow's codec. Parts are numbered in
order of the rows. A part appears whole; a repeated task replaces its own part.

Edge cases: null lines are empty ones; empty input gives a folder with one part
that has the heading only; text may hold line breaks inside quoted CSV fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.session import delete_path
from statelake.sources.blobs import Store
from statelake.sources.paths import Folder

SUFFIX = {None: "", "gz": ".gz", "zst": ".zst"}
CHUNK = 1 << 20
_PART = pa.schema([("part", pa.string()), ("lines", pa.int64())])


def _codec(codec: str | None) -> str | None:
    if codec not in SUFFIX:
        raise ValueError(f"unknown codec {codec!r}")
    return {"gz": "gzip", "zst": "zstd"}.get(codec)


def write_lines(lines: DataFrame, folder: str, codec: str | None = None, head: str | None = None) -> None:
    """Replace ``folder`` by parts with the text of the one column of ``lines``; every part begins with ``head``.

    Parts are written beside it, and take its place when all are there.
    """
    kind = _codec(codec)
    folder = Folder(lines.sparkSession, folder).uri
    draft = f"{folder}.draft"
    delete_path(lines.sparkSession, draft)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count = TaskContext.get().partitionId(), 0
        batch = next(batches, None)
        if batch is None and number:
            return
        part = f"part-{number:06d}{SUFFIX[codec]}"
        with Store(draft).writing(part) as sink:
            out = pa.CompressedOutputStream(sink, kind) if kind else sink
            if head is not None:
                out.write(head.encode() + b"\n")
            while batch is not None:
                texts = batch.column(0).to_pylist()
                count += len(texts)
                out.write("".join(f"{t or ''}\n" for t in texts).encode())
                batch = next(batches, None)
            if kind:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([count])], schema=_PART)

    made = lines.select(F.col(f"`{lines.columns[0]}`").cast("string")).mapInArrow(write, "part string, lines bigint")
    if not made.agg(F.count(F.lit(1))).first()[0]:  # no partition at all
        Store(draft).put(f"part-000000{SUFFIX[codec]}", _whole(b"" if head is None else f"{head}\n".encode(), kind))
    Folder(lines.sparkSession, folder).replace_by(draft)


def _whole(data: bytes, kind: str | None) -> bytes:
    sink = pa.BufferOutputStream()
    if not kind:
        return data
    with pa.CompressedOutputStream(sink, kind) as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


def parts(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """``(path, codec)`` of the parts of an export, or of a single file, in order."""
    here = Folder(spark, path)
    path = here.uri
    names = [f"{path}/{n}" for n in here.names() if not n.startswith("_")]
    if names == [f"{path}/{path.rstrip('/').rpartition('/')[2]}"]:
        names = [path]
    return [(n, "zst" if n.endswith(".zst") else "gz" if n.endswith(".gz") else None) for n in names]


def open_part(path: str, codec: str | None):
    folder, _, name = path.rpartition("/")
    stream = Store(folder).open(name)
    return pa.CompressedInputStream(stream, _codec(codec)) if codec else stream


def is_zst(spark: SparkSession, path: str) -> bool:
    return any(codec == "zst" for _, codec in parts(spark, path))


def _paths(spark: SparkSession, path: str) -> DataFrame:
    found = parts(spark, path)
    return spark.createDataFrame(found, "path string, codec string").repartition(max(1, len(found)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of all parts, a task per part; a task holds one chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, codec in zip(*[c.to_pylist() for c in batch.columns]):
                with open_part(name, codec) as stream:
                    rest = b""
                    while chunk := stream.read(CHUNK):
                        *whole, rest = (rest + chunk).split(b"\n")
                        if whole:
                            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in whole])], names=["value"])
                    if rest:
                        yield pa.RecordBatch.from_arrays([pa.array([rest.decode()])], names=["value"])

    return _paths(spark, path).mapInArrow(read, "value string")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of CSV parts with a heading each, read by a streaming parser; absent columns are null, empty texts too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, codec in zip(*[c.to_pylist() for c in batch.columns]):
                with open_part(name, codec) as stream:
                    options = pacsv.ConvertOptions(column_types={c: pa.string() for c in columns}, include_columns=columns, include_missing_columns=True, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
                    for table in pacsv.open_csv(stream, parse_options=pacsv.ParseOptions(newlines_in_values=True), convert_options=options):
                        yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in table.columns], names=columns)

    return _paths(spark, path).mapInArrow(read, ", ".join(f"{c} string" for c in columns))


def stream_out(spark: SparkSession, path: str, out, head: bool = False) -> int:
    """Write an export to one open binary file, decompressed, part by part and chunk by chunk; of several headings the first is kept. Returns the bytes."""
    total = 0
    for number, (name, codec) in enumerate(parts(spark, path)):
        with open_part(name, codec) as stream:
            skip = head and number > 0
            while chunk := stream.read(CHUNK):
                if skip:
                    line, mark, chunk = chunk.partition(b"\n")
                    skip = not mark
                out.write(chunk)
                total += len(chunk)
    return total
