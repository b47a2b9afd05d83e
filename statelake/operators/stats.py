"""Counts and facets of a dataset. Every distinct count is exact and combined on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelake.registry import Registry


def count_entities(live: DataFrame) -> DataFrame:
    return live.agg(F.countDistinct("entity_id").alias("entities"))


def by_schema(live: DataFrame, registry: Registry) -> DataFrame:
    """``kind, schema, entities``; kind is things, intervals or other."""
    things, intervals = registry.descendants("Thing"), registry.descendants("Interval")
    kind = F.when(F.col("schema").isin(things), "things").when(F.col("schema").isin(intervals), "intervals").otherwise("other")
    return live.groupBy("schema").agg(F.countDistinct("entity_id").alias("entities")).select(kind.alias("kind"), "schema", "entities")


def facets(live: DataFrame, prop_type: str = "country") -> DataFrame:
    """``value, entities`` for all values of one property type."""
    return live.where((F.col("prop_type") == prop_type) & F.col("value").isNotNull()).groupBy("value").agg(F.countDistinct("entity_id").alias("entities"))


def span(live: DataFrame) -> DataFrame:
    """``first_seen, last_seen, statements, entities`` of the dataset."""
    return live.agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("statements"), F.countDistinct("entity_id").alias("entities"))


def summary(live: DataFrame, registry: Registry) -> dict:
    """The statistics document of a dataset: a few numbers per type and country."""
    out = live.select("entity_id", "schema", "prop_type", "value", "first_seen", "last_seen")
    whole = span(out).first()
    kinds: dict = {"things": {"total": 0, "schemata": []}, "intervals": {"total": 0, "schemata": []}, "other": {"total": 0, "schemata": []}}
    for row in by_schema(out, registry).orderBy("schema").collect():
        kinds[row["kind"]]["total"] += row["entities"]
        kinds[row["kind"]]["schemata"].append({"name": row["schema"], "count": row["entities"]})
    countries = [{"code": r["value"], "count": r["entities"]} for r in facets(out).orderBy(F.desc("entities"), "value").collect()]
    iso = lambda t: t.isoformat() if t else None
    return {"entity_count": whole["entities"], "statement_count": whole["statements"], "first_seen": iso(whole["first_seen"]), "last_seen": iso(whole["last_seen"]), **kinds, "countries": countries}
