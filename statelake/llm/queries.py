"""Queries of the text operators, over whole tables, and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.llm.lookalike import canonical_form, form_digests, form_sql, same_look_classes, same_look_pairs
from statelake.llm.packing import pack
from statelake.llm.tokenize import token_counts, token_ids, vocabulary
from statelake.session import Scratch, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    profiles = table(spark, sf_dir, "pack_profiles").where("capacity > 0").orderBy("profile").collect()  # a handful of settings
    documents = table(spark, sf_dir, "documents")
    counts = {t: scratch.stage(token_counts(documents, path=vocabulary(t)), "counts") for t in {p["tokenizer"] for p in profiles}}
    parts = [pack(counts[p["tokenizer"]], p["capacity"]).select(F.lit(p["profile"]).alias("profile"), F.lit(p["capacity"]).alias("capacity"), "*") for p in profiles]
    return reduce(DataFrame.unionByName, parts)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("profile", "container_no", F.col("item").alias("doc_id"), "piece_no", "token_from", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _packed(spark, sf_dir).groupBy("profile", "capacity", "container_no").agg(F.sum("n_tokens").alias("used"))
    return used.groupBy("profile", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum(F.col("capacity") - F.col("used")).alias("unused"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = Scratch(spark, "lookalike").stage(form_digests(table(spark, sf_dir, "documents")), "digests")
    return same_look_pairs(digests)


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the classes of texts that look the same, one row per document."""
    return same_look_classes(Scratch(spark, "lookalike").stage(form_digests(table(spark, sf_dir, "documents")), "digests"))


def p10_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_form(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p8_ids, p9_packed, p9_fill, p10_found, p10_classes, p10_form)}


def oracle_sql() -> dict[str, str]:
    """The form's SQL is itself DuckDB's; tests hold it against an independent version in Python."""
    form = form_sql("text")
    return {
        "p10_form": f"SELECT doc_id, {form} AS form FROM documents",
        "p10_found": f"""
            WITH f AS (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL),
                 v AS (SELECT * FROM f WHERE regexp_matches(form, '[^\\s]'))
            SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
            FROM v a JOIN v b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    }
