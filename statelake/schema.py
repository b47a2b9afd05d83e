"""The statement table: columns, required set, partitions and CSV projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order, the required set, partition keys and the CSV columns.
COLUMNS = [
    ("shard", "string"), ("id", "string"), ("entity_id", "string"), ("dataset", "string"), ("bucket", "string"), ("origin", "string"),
    ("source", "string"), ("schema", "string"), ("prop", "string"), ("prop_type", "string"), ("value", "string"), ("original_value", "string"),
    ("lang", "string"), ("external", "boolean"), ("first_seen", "timestamp"), ("last_seen", "timestamp"), ("fragment", "string"), ("deleted_at", "timestamp"),
]
REQUIRED = ["shard", "id", "entity_id", "dataset", "bucket", "origin", "schema", "prop", "value", "external", "first_seen", "last_seen", "fragment"]
PARTITIONS = ["shard", "bucket", "origin"]
CSV_COLUMNS = [
    "id", "entity_id", "canonical_id", "prop", "prop_type", "schema", "value", "original_value", "dataset", "origin", "lang", "external",
    "first_seen", "last_seen", "fragment",
]
BASE_ID = "id"

NAMES = [name for name, _ in COLUMNS]
STRUCT = T.StructType([T.StructField(n, T.StringType() if t == "string" else T.BooleanType() if t == "boolean" else T.TimestampType(), n not in REQUIRED) for n, t in COLUMNS])
NULLABLE = T.StructType([T.StructField(f.name, f.dataType, True) for f in STRUCT])


def conform(df: DataFrame, naive: bool = False) -> DataFrame:
    """Exactly the statement columns, cast and in order; extra columns are dropped, missing optional ones are null.

    ``naive`` keeps timestamps without a zone, as the given parquet tables have them.
    """
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, kind in COLUMNS:
        kind = "timestamp_ntz" if naive and kind == "timestamp" else kind
        if name in have:
            column = F.col(f"`{have[name]}`").cast(kind)
        elif name in REQUIRED and name != "fragment":
            raise ValueError(f"statements lack the column {name!r}")
        else:
            column = F.lit(None).cast(kind)
        out.append((F.coalesce(column, F.lit("")) if name == "fragment" else column).alias(name))
    return df.select(*out)


def enforce_required(df: DataFrame) -> DataFrame:
    """Fail the job at the first row with a null in a required column."""
    checks = [F.assert_true(F.col(c).isNotNull(), F.lit(f"statement without {c}")) for c in REQUIRED]
    ok = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in checks])
    return df.where(F.size(ok) > 0)


def raw_view(statements: DataFrame) -> DataFrame:
    """Every physical row."""
    return statements.select(*NAMES)


def live_view(statements: DataFrame) -> DataFrame:
    """Rows that are not tombstones, with ``canonical_id``. No window, so every filter reaches the scan."""
    return statements.select(*NAMES).where(F.col("deleted_at").isNull()).withColumn("canonical_id", F.col("entity_id"))


def register_views(statements: DataFrame) -> None:
    """``statement`` and ``statement_raw`` for SQL."""
    raw_view(statements).createOrReplaceTempView("statement_raw")
    live_view(statements).createOrReplaceTempView("statement")
