"""Statement CSV, entity JSON lines, Arrow streams, compressed exports."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.functions.ids import entity_shard, statement_id
from statelake.functions.values import resolve_origin
from statelake.registry import Registry
from statelake.schema import CSV_COLUMNS, NAMES
from statelake.sources import compressed

ENTITY_SCHEMA = "id string, schema string, properties map<string,array<string>>, caption string, referents array<string>, datasets array<string>, origin array<string>, fragment string, last_change string"
DOCUMENT_COLUMNS = ["id", "checksum", "name", "mimetype", "path", "size", "updated_at", "public_url"]
NON_LINGUISTIC = ["date", "number", "country", "entity", "checksum", "mimetype", "identifier", "language", "url"]


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Statement CSV as text columns, plain, gzip or zstd; absent optional columns are null, extra ones are dropped.

    A quoted field may hold line breaks, so a file is read by one task; exports have many.
    """
    if compressed.is_zst(spark, path):
        return compressed.read_csv(spark, path, CSV_COLUMNS)
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(found.columns)
    return found.select(*[(F.nullif(F.col(f"`{c}`"), F.lit("")) if c in have else F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS])


def statements_from_csv(rows: DataFrame, registry: Registry, dataset: str, shards: int = 1, now: str = "1970-01-01", origin: str | None = None, override_origin: str | None = None) -> DataFrame:
    """Packed statement rows: ids derived anew under ``dataset``, types from the registry, dates defaulted, language only where it means something."""
    spark = rows.sparkSession
    known = registry.prop_frame(spark).withColumnRenamed("prop_type", "known_type")
    typed = rows.where("entity_id is not null and prop is not null and value is not null").join(F.broadcast(known), ["schema", "prop"], "left")
    kind = F.when(F.col("prop") == "id", "checksum").otherwise(F.coalesce("known_type", "prop_type"))
    external = F.coalesce(F.lower(F.trim("external")).isin("true", "1", "t", "yes"), F.lit(False))
    lang = F.when(~F.coalesce(kind.isin(NON_LINGUISTIC), F.lit(False)), F.col("lang"))
    first = F.coalesce(F.col("first_seen").try_cast("timestamp"), F.lit(now).cast("timestamp"))
    out = typed.select(
        entity_shard(F.col("entity_id"), shards).alias("shard"), "entity_id", F.lit(dataset).alias("dataset"), registry.bucket_column(F.col("schema")).alias("bucket"),
        resolve_origin(override_origin, F.col("origin"), origin).alias("origin"),
        F.lit(None).cast("string").alias("source"), "schema", "prop", kind.alias("prop_type"), "value", "original_value", lang.alias("lang"), external.alias("external"),
        first.alias("first_seen"), F.coalesce(F.col("last_seen").try_cast("timestamp"), first).alias("last_seen"), F.coalesce("fragment", F.lit("")).alias("fragment"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    ).withColumn("id", statement_id(F.col("dataset"), F.col("entity_id"), F.col("prop"), F.col("value"), F.col("external"), F.col("lang")))
    return out.select(*NAMES)


def csv_projection(live: DataFrame) -> DataFrame:
    """The CSV columns, times as ISO text, in order of entity."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return live.withColumn("canonical_id", F.col("entity_id")).select(*[iso(c) if c in ("first_seen", "last_seen") else F.col(c) for c in CSV_COLUMNS]).orderBy("entity_id", "id", "fragment")


def write_csv(live: DataFrame, path: str, codec: str | None = None) -> None:
    """CSV parts in order of entity, each with a heading. Sorted by range, so that no single task holds all rows."""
    rows = csv_projection(live)
    compressed.write_lines(rows.select(csv_line(rows.columns)), path, codec, ",".join(rows.columns))


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV: fields with commas, quotes, blanks at an end or line breaks are quoted, quotes inside doubled; nulls are empty."""
    return F.to_csv(F.struct(*columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("value")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain, gzip or zstd; properties become a map of lists. ``origin`` and ``fragment`` may be text or a list."""
    schema = ENTITY_SCHEMA.replace("origin array<string>", "origin string")
    if compressed.is_zst(spark, path):
        return compressed.read_lines(spark, path).select(F.from_json("value", schema).alias("e")).select("e.*")
    return spark.read.schema(schema).json(path)


def write_entities(entities: DataFrame, path: str, codec: str | None = None) -> None:
    compressed.write_lines(entities.select(F.to_json(F.struct(*entities.columns)).alias("value")), path, codec)


def wrap(data: bytes, codec: str | None) -> bytes:
    """``gz`` (without a time stamp) or ``zst``; ``None`` leaves the data as it is."""
    if not codec:
        return data
    if codec == "gz":
        return gzip.compress(data, mtime=0)
    if codec == "zst":
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "zstd") as stream:
            stream.write(data)
        return sink.getvalue().to_pybytes()
    raise ValueError(f"unknown codec {codec!r}")


def unwrap(data: bytes, codec: str | None) -> bytes:
    if not codec:
        return data
    if codec == "gz":
        return gzip.decompress(data)
    if codec == "zst":
        return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    raise ValueError(f"unknown codec {codec!r}")


def to_ipc(table: pa.Table) -> bytes:
    """An Arrow stream with zstd buffers."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    table = pa.ipc.open_stream(data).read_all()
    return spark.createDataFrame(table)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A document listing as it was exported."""
    if compressed.is_zst(spark, path):
        text = compressed.read_csv(spark, path, DOCUMENT_COLUMNS)
        return text.select(*[F.col(c).cast({"size": "bigint", "updated_at": "timestamp"}.get(c, "string")).alias(c) for c in DOCUMENT_COLUMNS])
    return spark.read.schema("id string, checksum string, name string, mimetype string, path string, size bigint, updated_at timestamp, public_url string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
