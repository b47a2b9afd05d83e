"""Identity and hashing rules as column expressions, and as SQL functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def shard_hex_width(shards: int) -> int:
    """Hex digits that number ``shards`` shards."""
    return max(1, -(-(max(shards, 1) - 1).bit_length() // 4))


def shard_key(entity_id: str, shards: int) -> str:
    """The shard of one id, on the driver (used to prune partitions)."""
    if shards <= 1:
        return "0"
    return format(int(hashlib.sha1(entity_id.encode()).hexdigest()[:8], 16) % shards, f"0{shard_hex_width(shards)}x")


def entity_shard(entity_id: Column, shards: int) -> Column:
    if shards <= 1:
        return F.lit("0")
    number = F.conv(F.substring(F.sha1(entity_id), 1, 8), 16, 10).cast("long") % F.lit(shards)
    return F.lpad(F.lower(F.hex(number)), shard_hex_width(shards), "0")


def statement_id(dataset: Column, entity_id: Column, prop: Column, value: Column, external: Column, lang: Column) -> Column:
    """Content hash of a statement under its dataset; null if there is no value.

    Every part but the last is preceded by its length, so no two statements have one text, whatever their parts hold.
    """
    sized = [x for c in (dataset, entity_id, prop) for x in (F.length(c).cast("string"), c)]
    flags = [F.when(external, "1").otherwise("0"), F.coalesce(F.length(lang), F.lit(-1)).cast("string"), F.coalesce(lang, F.lit(""))]
    parts = F.concat_ws("|", *sized, *flags, value)
    return F.when(value.isNotNull() & entity_id.isNotNull() & prop.isNotNull(), F.sha1(parts))


def base_checksum(schema: Column, ids: Column) -> Column:
    """Checksum of an entity: its schema and its distinct statement ids in order."""
    return F.sha1(F.concat(schema, F.array_join(F.array_sort(F.array_distinct(ids)), "")))


def dedupe_key(id: Column, origin: Column, fragment: Column) -> Column:
    """Row identity: id, origin and fragment, tab-separated; absent parts are empty."""
    return F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in (id, origin, fragment)])


def file_id(path: Column, checksum: Column) -> Column:
    return F.concat(F.lit("file-"), F.sha2(F.concat(path, checksum), 256))


def folder_id(name: Column, parent: Column | None = None) -> Column:
    own = name if parent is None else F.concat(F.coalesce(parent, F.lit("")), name)
    return F.concat(F.lit("folder-"), F.sha2(own, 256))


def path_names(path: Column) -> Column:
    """The names along a path; ``\\`` separates like ``/``, empty and ``.`` segments mean nothing, white space is kept."""
    return F.filter(F.split(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/"), lambda s: (s != "") & (s != "."))


def folder_names(key: Column) -> Column:
    """The names of the folders in a file's key: all but the last."""
    names = path_names(key)
    return F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))


def folder_chain(directory: Column) -> Column:
    """Ids of the folders along a path."""
    return folder_ids(path_names(directory))


def folder_ids(names: Column) -> Column:
    """Ids of the folders with these names, outermost first: each hashes its parent's id and its own name."""

    def step(done: Column, name: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.concat(F.lit("folder-"), F.sha2(F.concat(last, name), 256))))

    return F.aggregate(names, F.array().cast("array<string>"), step)


def blob_key(checksum: Column) -> Column:
    """``archive/ab/cd/ef/<checksum>/blob``; null for anything that is not a SHA-256 in lower hex."""
    pair = [F.substring(checksum, i, 2) for i in (1, 3, 5)]
    return F.when(checksum.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.lit("archive"), *pair, checksum, F.lit("blob")))


def strip_namespace(id: Column) -> Column:
    """The id without its signature (the part after the last dot); null if what is left is not a clean id."""
    bare = F.regexp_replace(F.trim(id), r"\.[^.]*$", "")
    return F.when(bare.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), bare)


def register_sql_functions(spark: SparkSession) -> None:
    """``entity_shard(id, n)``, ``strip_namespace(id)`` and ``statement_id(…)`` as SQL functions that Catalyst inlines."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION entity_shard(id STRING, n INT) RETURNS STRING RETURN CASE WHEN n <= 1 THEN '0' ELSE "
        "lpad(lower(hex(cast(conv(substr(sha1(id), 1, 8), 16, 10) AS BIGINT) % n)), cast(greatest(1, ceil(ceil(log2(greatest(n, 2))) / 4)) AS INT), '0') END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strip_namespace(id STRING) RETURNS STRING RETURN "
        r"nullif(regexp_extract(regexp_replace(trim(id), '\\.[^.]*$', ''), '^[A-Za-z0-9][A-Za-z0-9._-]*$', 0), '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION statement_id(dataset STRING, entity_id STRING, prop STRING, value STRING, external BOOLEAN, lang STRING) RETURNS STRING RETURN "
        "CASE WHEN value IS NOT NULL AND entity_id IS NOT NULL AND prop IS NOT NULL THEN "
        "sha1(concat_ws('|', string(length(dataset)), dataset, string(length(entity_id)), entity_id, string(length(prop)), prop, "
        "CASE WHEN external THEN '1' ELSE '0' END, string(coalesce(length(lang), -1)), coalesce(lang, ''), value)) END"
    )
