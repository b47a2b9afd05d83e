"""The document listing: one row per document and place in the folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelake.functions.ids import file_id, folder_ids, folder_names, path_names
from statelake.functions.values import guess_mime, mime_schema, normal_mime, pick_mime, public_url
from statelake.operators.hierarchy import path_text, resolve

CSV_COLUMNS = ["id", "checksum", "name", "mimetype", "path", "size", "updated_at", "public_url"]


def first(entity: str, prop: str):
    return F.array_min(F.col(entity)[prop])


def folder_paths(folders: DataFrame) -> DataFrame:
    """``id, path`` of folder entities (``id, properties``) by their parents; loops have no path."""
    nodes = folders.select("id", first("properties", "parent").alias("parent"), F.coalesce(first("properties", "fileName"), F.lit("")).alias("name"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "name")
    return resolve(linked).where("depth >= 0").select("id", path_text().alias("path"))


def place(documents: DataFrame, paths: DataFrame, key: str = "id", parents: str = "parents") -> DataFrame:
    """``documents`` with ``path``: one row per parent that has one, or one row without a path if none has."""
    each = documents.select(F.col(key).alias("__k"), F.explode(parents).alias("__p")).join(paths.select(F.col("id").alias("__p"), "path"), "__p").select("__k", "path").distinct()
    return documents.join(each, documents[key] == each["__k"], "left").drop("__k")


def listing(entities: DataFrame, paths: DataFrame, schemata: list[str], dataset: str, url: str | None = None) -> DataFrame:
    """Rows of ``CSV_COLUMNS`` for entities that have content; several values of a property give the smallest."""
    wanted = [s for s in schemata if s != "Folder"]
    docs = entities.where(F.col("schema").isin(wanted) & first("properties", "contentHash").isNotNull())
    flat = docs.select(
        "id",
        first("properties", "contentHash").alias("checksum"),
        F.coalesce(first("properties", "fileName"), F.col("caption")).alias("name"),
        F.coalesce(F.col("properties")["mimeType"], F.array().cast("array<string>")).alias("mimetypes"),
        F.coalesce(first("properties", "fileSize").try_cast("decimal(38,0)").try_cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
        F.col("last_change").alias("updated_at"),
        F.coalesce(F.col("properties")["parent"], F.array().cast("array<string>")).alias("parents"),
    )
    flat = flat.withColumn("mimetype", pick_mime(F.col("mimetypes"), guess_mime(F.col("name"))))
    placed = place(flat, paths)
    return placed.withColumn("public_url", public_url(url, dataset, F.col("checksum"))).select(*CSV_COLUMNS)


def relative_path():
    """``path/name``; the name alone without a path."""
    return F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.col("name"))


def file_entities(files: DataFrame, *more: Column) -> DataFrame:
    """Entity payloads of archived files: ``id, schema, properties, origin`` and ``more``. The folder named by the key's directory is the parent; a file at the root has none."""
    key = F.col("key")
    chain = folder_ids(folder_names(key))
    values = {
        "contentHash": F.col("checksum"),
        "fileName": F.coalesce(F.col("name"), F.try_element_at(path_names(key), F.lit(-1))),
        "fileSize": F.col("size").cast("string"),
        "mimeType": normal_mime(F.col("mimetype")),
        "parent": F.try_element_at(chain, F.lit(-1)),
        "title": F.get_json_object("extra", "$.title"),
        "author": F.get_json_object("extra", "$.author"),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(p).alias("key"), F.array(v).alias("value")) for p, v in values.items()]), lambda e: e["value"][0].isNotNull())
    return files.select(file_id(key, F.col("checksum")).alias("id"), mime_schema(F.col("mimetype")).alias("schema"), F.map_from_entries(pairs).alias("properties"), "origin", *more)


def folder_entities(files: DataFrame) -> DataFrame:
    """Entity payloads of the folders on the way to each file, once each."""
    names = folder_names(F.col("key"))
    rows = files.select(folder_ids(names).alias("ids"), names.alias("names")).select(F.posexplode(F.arrays_zip("ids", "names")).alias("at", "n"), "ids")
    rows = rows.select(F.col("n.ids").alias("id"), F.col("n.names").alias("name"), F.when(F.col("at") > 0, F.element_at("ids", F.col("at"))).alias("parent")).distinct()
    pairs = F.filter(F.array(F.struct(F.lit("fileName").alias("key"), F.array("name").alias("value")), F.struct(F.lit("parent").alias("key"), F.array("parent").alias("value"))), lambda e: e["value"][0].isNotNull())
    return rows.select("id", F.lit("Folder").alias("schema"), F.map_from_entries(pairs).alias("properties"))
