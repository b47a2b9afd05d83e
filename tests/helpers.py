"""Small statement tables."""

from datetime import datetime, timedelta

from statelake.schema import NULLABLE

T0 = datetime(2024, 1, 1)


def at(day: float) -> datetime:
    return T0 + timedelta(days=day)


def statement(id="s1", entity="e1", prop="name", value="v", first=0.0, last=None, fragment="", deleted=None, origin="ingest", shard="0", bucket="thing", schema="Company", **other):
    row = {
        "shard": shard, "id": id, "entity_id": entity, "dataset": "ds", "bucket": bucket, "origin": origin, "source": None, "schema": schema, "prop": prop, "prop_type": None,
        "value": value, "original_value": None, "lang": None, "external": False, "first_seen": None if first is None else at(first), "last_seen": None if first is None and last is None else at(first if last is None else last),
        "fragment": fragment, "deleted_at": None if deleted is None else at(deleted),
    }
    return row | other


def statements(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in NULLABLE) for r in rows], NULLABLE)
