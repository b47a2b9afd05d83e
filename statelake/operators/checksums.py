"""Checksums of entities over any number of statements.

The checksum of an entity is a hash over its statement ids in order. Ids are
made distinct with map-side combine, brought together and sorted by Spark, and
hashed as they stream by: a task holds one hash state, never the ids of an
entity, even of one with a third of all rows.

Edge cases: rows without entity or id take no part; repeated ids count once; of
several schemata the smallest counts; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = pa.schema([("entity_id", pa.string()), ("checksum", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entity, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
        done = []
        for lo, hi in zip(starts, [*starts[1:], len(codes)]):
            name = batch.column(0)[lo].as_py()
            if name != entity:
                if entity is not None:
                    done.append((entity, state.hexdigest()))
                entity, state = name, hashlib.sha1((batch.column(1)[lo].as_py() or "").encode())
            state.update("".join(batch.column(2).slice(lo, hi - lo).to_pylist()).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=_OUT)
    if entity is not None:
        yield pa.RecordBatch.from_arrays([pa.array([entity]), pa.array([state.hexdigest()])], schema=_OUT)


def entity_checksums(rows: DataFrame) -> DataFrame:
    """``entity_id, checksum``: the hash of the entity's schema and its distinct statement ids in order."""
    known = rows.where("entity_id is not null and id is not null")
    schema = known.groupBy("entity_id").agg(F.min("schema").alias("schema"))
    pairs = known.select("entity_id", "id").distinct().join(schema, "entity_id")
    placed = pairs.select("entity_id", "schema", "id").repartition("entity_id").sortWithinPartitions("entity_id", "id")
    return placed.mapInArrow(_digests, "entity_id string, checksum string")
