"""Change feeds: what differs since a moment, as envelopes of whole entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelake.operators.assemble import assemble
from statelake.registry import Registry


def changed_ids(raw: DataFrame, since: str) -> DataFrame:
    """Ids with a row first seen or deleted at or after ``since``."""
    moment = F.lit(since).cast(raw.schema["first_seen"].dataType)
    return raw.where((F.col("first_seen") >= moment) | (F.col("deleted_at") >= moment)).select("entity_id").where("entity_id is not null").distinct()


def diff(raw: DataFrame, since: str | None, registry: Registry) -> DataFrame:
    """``op, id, entity``: ADD with the whole current entity, DEL for an id without live rows. ``since=None`` is the initial full feed.

    ``raw`` is read twice, for the state of each entity and for the rows of those that have changed, so it should be a table.
    """
    live = raw.where("deleted_at is null")
    if since is None:
        current = assemble(live, registry)
        return current.select(F.lit("ADD").alias("op"), "id", F.struct(*current.columns).alias("entity"))
    moment = F.lit(since).cast(raw.schema["first_seen"].dataType)
    new = F.coalesce(F.col("first_seen") >= moment, F.lit(False)) | F.coalesce(F.col("deleted_at") >= moment, F.lit(False))
    states = raw.where("entity_id is not null").groupBy("entity_id").agg(F.max(new).alias("changed"), F.max(F.col("deleted_at").isNull()).alias("alive")).where("changed")
    current = assemble(live.join(states.where("alive").select("entity_id"), "entity_id", "left_semi"), registry)
    added = current.select(F.lit("ADD").alias("op"), "id", F.struct(*current.columns).alias("entity"))
    removed = states.where("not alive").select(F.lit("DEL").alias("op"), F.col("entity_id").alias("id"), F.lit(None).cast(added.schema["entity"].dataType).alias("entity"))
    return added.unionByName(removed)


def envelopes(feed: DataFrame) -> DataFrame:
    """One JSON line per change: ``{"op": ..., "entity": {...}}``; of a deleted entity only the id is left."""
    body = F.when(F.col("op") == "ADD", F.to_json("entity")).otherwise(F.to_json(F.struct("id")))
    return feed.select(F.concat(F.lit('{"op":"'), F.col("op"), F.lit('","entity":'), body, F.lit("}")).alias("value"))
