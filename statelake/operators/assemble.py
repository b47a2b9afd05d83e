"""Statements into whole entities and back.

``assemble`` groups live statements in two levels over one scan: distinct values
per (entity, property) first, with map-side combine, then one row per entity. The
row itself holds every value of its entity, as the result is defined; what is
shuffled is distinct values only.

Edge cases: duplicate values appear once; lists are sorted, so results do not
depend on row order; entities whose types are all unknown or have nothing in
common are dropped; the checksum row (property ``id``) gives no property but
dates the last change; null values and properties are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelake.functions.ids import base_checksum, entity_shard, statement_id, strip_namespace
from statelake.functions.values import resolve_origin, single_string
from statelake.registry import Registry
from statelake.schema import BASE_ID, NAMES

ENTITY = (
    "id string, schema string, properties map<string,array<string>>, caption string, referents array<string>, datasets array<string>, "
    "origin array<string>, first_seen timestamp, last_seen timestamp, last_change timestamp"
)


def assemble(live: DataFrame, registry: Registry) -> DataFrame:
    """One row per entity: id, schema, caption, properties, datasets, origin and its dates."""
    named = F.col("prop") != BASE_ID
    sets = ("schema", "dataset", "origin")
    props = live.where("entity_id is not null").groupBy("entity_id", "prop").agg(
        F.collect_set(F.when(named, F.col("value"))).alias("values"),
        *[F.collect_set(c).alias(c) for c in sets],
        F.min("first_seen").alias("first_seen"),
        F.max("first_seen").alias("change"),
        F.max("last_seen").alias("last_seen"),
    )
    joined = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in sets]
    facts = props.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.size("values") > 0, F.struct("prop", F.array_sort("values").alias("values")))))).alias("properties"),
        *[c.alias(name) for c, name in zip(joined, ("schemata", "datasets", "origin"))],
        F.min(F.when(named, F.col("first_seen"))).alias("first_seen"),
        F.max(F.when(named, F.col("last_seen"))).alias("last_seen"),
        F.max(F.when(~named, F.col("change"))).alias("last_change"),
    )
    whole = facts.withColumn("schema", registry.merge_column(F.col("schemata"))).where("schema is not null")
    properties = F.coalesce("properties", F.create_map().cast("map<string,array<string>>"))
    return whole.select(
        F.col("entity_id").alias("id"),
        "schema",
        registry.caption_column(F.col("schema"), properties).alias("caption"),
        properties.alias("properties"),
        F.array().cast("array<string>").alias("referents"),
        "datasets",
        "origin",
        "first_seen",
        "last_seen",
        "last_change",
    )


def explode(entities: DataFrame, registry: Registry, dataset: str, shards: int = 1, now: str = "1970-01-01", origin: str | None = None, override_origin: str | None = None) -> DataFrame:
    """Statement rows of entity payloads (``id, schema, properties``, optional ``origin``, ``fragment``, ``last_change``), plus a checksum row each.

    Payloads without id or schema give no rows; an unknown schema fails the job. Unknown and computed properties, empty
    values and repeated statements of one entity are skipped. Ids lose their signature, also in references. Every id is
    derived anew under ``dataset``. Both dates are the payload's last change, or ``now``.
    """
    spark = entities.sparkSession
    have = set(entities.columns)
    kind = dict(entities.dtypes)

    def one(name: str):
        if name not in have:
            return F.lit(None).cast("string")
        return single_string(F.col(name)) if kind[name].startswith("array") else F.col(name).cast("string")

    schemas = list(registry.parents)
    checked = F.when(F.col("schema").isin(schemas), F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("unknown schema: "), F.col("schema"))).cast("string"))
    seen = F.coalesce((F.col("last_change") if "last_change" in have else F.lit(None)).cast("timestamp"), F.lit(now).cast("timestamp"))
    base = entities.where("id is not null and schema is not null").select(
        strip_namespace(F.col("id")).alias("entity_id"),
        checked.alias("schema"),
        "properties",
        resolve_origin(override_origin, one("origin"), origin).alias("origin"),
        F.coalesce(one("fragment"), F.lit("")).alias("fragment"),
        seen.alias("first_seen"),
    ).where("entity_id is not null")
    rows = base.select("entity_id", "schema", "origin", "fragment", "first_seen", F.explode_outer("properties").alias("prop", "values"))
    rows = rows.select("entity_id", "schema", "origin", "fragment", "first_seen", "prop", F.explode_outer("values").alias("value"))
    known = registry.prop_frame(spark)  # the type lattice: a few hundred rows, independent of the data
    typed = rows.join(F.broadcast(known), ["schema", "prop"], "left").where("prop_type is not null and value <> ''")
    typed = typed.withColumn("value", F.when(F.col("prop_type") == "entity", strip_namespace(F.col("value"))).otherwise(F.col("value"))).where("value is not null")
    no = F.lit(None).cast("string")
    typed = typed.withColumn("id", statement_id(F.lit(dataset), F.col("entity_id"), F.col("prop"), F.col("value"), F.lit(False), no)).dropDuplicates(["entity_id", "origin", "fragment", "id"])
    head = base.groupBy("entity_id", "schema", "origin", "fragment").agg(F.max("first_seen").alias("first_seen"))
    sums = typed.groupBy("entity_id", "schema", "origin", "fragment").agg(F.collect_set("id").alias("ids"))
    keys = ["entity_id", "schema", "origin", "fragment"]
    checksum = head.join(sums, keys, "left").withColumn("prop", F.lit(BASE_ID)).withColumn("prop_type", F.lit("checksum"))
    checksum = checksum.withColumn("value", base_checksum(F.col("schema"), F.coalesce("ids", F.array().cast("array<string>")))).drop("ids")
    checksum = checksum.withColumn("id", statement_id(F.lit(dataset), F.col("entity_id"), F.col("prop"), F.col("value"), F.lit(False), no))
    both = typed.select(checksum.columns).unionByName(checksum)
    return both.select(
        entity_shard(F.col("entity_id"), shards).alias("shard"), "id", "entity_id", F.lit(dataset).alias("dataset"), registry.bucket_column(F.col("schema")).alias("bucket"),
        "origin", no.alias("source"), "schema", "prop", "prop_type", "value", no.alias("original_value"), no.alias("lang"), F.lit(False).alias("external"), "first_seen",
        F.col("first_seen").alias("last_seen"), "fragment", F.lit(None).cast("timestamp").alias("deleted_at"),
    ).select(*NAMES)


def tombstones(rows: DataFrame, at: str) -> DataFrame:
    """Deletion markers for live rows: same identity, deleted and last seen ``at``."""
    kind = rows.schema["last_seen"].dataType
    when = F.lit(at).cast(kind)
    return rows.where("deleted_at is null").select(*NAMES).withColumn("deleted_at", when).withColumn("last_seen", when)


def override(base: DataFrame, buffered: DataFrame) -> DataFrame:
    """Rows of ``base`` with rows of ``buffered`` in place of those of equal ``(id, origin, fragment)``."""
    key = ["id", "origin", "fragment"]
    rows = base.select(*NAMES).withColumn("__p", F.lit(0)).unionByName(buffered.select(*NAMES).withColumn("__p", F.lit(1)))
    best = rows.groupBy(*key).agg(F.max(F.struct("__p", "last_seen", "deleted_at", *[c for c in NAMES if c not in (*key, "last_seen", "deleted_at")])).alias("r"))
    return best.select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in NAMES])
