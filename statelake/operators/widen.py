"""Attribute–value rows into one wide, typed row per entity.

Column-block pivoting: cells are written once, bucketed by entity and
partitioned by attribute block (``BLOCK`` attributes each, more if there would be
over ``MAX_BLOCKS`` blocks). Every block is then pivoted from its own files,
without a shuffle since the buckets are the groups, and the blocks are
merge-joined to the list of entities bucket by bucket, again without a shuffle
and without a broadcast: blocks grow with the entities. A task joins at most
``JOINED`` blocks; of more, the joins of ``JOINED`` each are written in the same
bucketing and joined in turn. A table of thousands of attributes costs one
shuffle of its cells, and generated code never sees more than one block's
columns at once.

Cells are reduced to one row per entity and attribute by aggregates with
map-side combine *before* they are distributed by entity, so an entity that
holds a third of all rows arrives as one row per attribute.

An attribute with several values has its smallest value in the wide row and the
number of distinct values in ``<attribute>__n``; the values themselves stay in
long form (:func:`many_values`), since no single row can hold an unbounded set.

Edge cases: rows with a null entity or attribute give no cell; the base row
``id`` gives none either, but an entity that has nothing else still gets its row;
values that do not parse leave the cell null; of several typed values of one cell
the smallest is taken; attributes that differ only in case from another, or are
named like the key, get a numbered suffix; empty input gives no rows but the full set of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelake.operators.cells import PARSERS
from statelake.session import Scratch, shuffle_partitions

BLOCK = 16
MAX_BLOCKS = 32
JOINED = 6  # tables that one task joins: each needs a sort buffer of its own
TYPES = {"date": "date", "decimal": "decimal(38,2)", "integer": "decimal(38,0)", "string": "string"}


def live_records(statements: DataFrame) -> DataFrame:
    """``entity_id, prop, value`` of each live record (newest row per ``id, origin, fragment``; a tombstone wins a tie)."""
    us = F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(-(2**61)))
    state = us * 2 + F.col("deleted_at").isNotNull().cast("long")
    rows = statements.select("id", "origin", F.coalesce("fragment", F.lit("")).alias("fragment"), "entity_id", "prop", "value", state.alias("state"))
    newest = rows.groupBy("id", "origin", "fragment").agg(F.max(F.struct("state", "entity_id", "prop", "value")).alias("r"))
    return newest.where("pmod(r.state, 2) = 0").select("r.entity_id", "r.prop", "r.value")


def attributes(schema_props: DataFrame) -> list[tuple[str, str, bool]]:
    """``(attribute, cell type, many)`` in name order. The registry is metadata: its size is that of the schema, not of the data."""
    rows = schema_props.where("prop is not null and prop <> 'id'").groupBy("prop").agg(F.min("cell_type").alias("t"), F.max("many").alias("m")).orderBy("prop").collect()
    return [(r["prop"], r["t"] if r["t"] in TYPES else "string", bool(r["m"])) for r in rows]


def column_names(props: list[tuple[str, str, bool]]) -> dict[str, str]:
    taken, names = {"entity_id"}, {}
    for prop, _, many in props:
        name, n = prop, 1
        while {name.lower(), f"{name}__n".lower() if many else name.lower()} & taken:
            n += 1
            name = f"{prop}_{n}"
        taken |= {name.lower()} | ({f"{name}__n".lower()} if many else set())
        names[prop] = name
    return names


def _of_type(props: list[tuple[str, str, bool]], kind: str) -> Column:
    names = [p for p, t, _ in props if t == kind]
    return F.col("prop").isin(names) if names else F.lit(False)


def cells(records: DataFrame, props: list[tuple[str, str, bool]]) -> DataFrame:
    """``entity_id, prop, cell, n``: canonical text of each filled cell and its number of distinct values."""
    text = F.col("value")
    for kind, parse in PARSERS.items():
        text = F.when(_of_type(props, kind), parse(F.col("value")).cast("string")).otherwise(text)
    known = records.where(F.col("prop").isin([p for p, _, _ in props]) & F.col("entity_id").isNotNull())
    # a generator, since a plain filter on the parsed text would be pushed below it and parse every value twice
    parsed = known.select("entity_id", "prop", F.explode(F.filter(F.array(text), lambda c: c.isNotNull())).alias("cell"))
    values = parsed.groupBy("entity_id", "prop", "cell").agg(F.lit(1).alias("one"))
    return values.groupBy("entity_id", "prop").agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("n"))


def many_values(records: DataFrame, props: list[tuple[str, str, bool]]) -> DataFrame:
    """Distinct ``entity_id, prop, value`` of attributes that allow several values."""
    many = [p for p, _, m in props if m]
    return records.where(F.col("prop").isin(many) & F.col("entity_id").isNotNull() & F.col("value").isNotNull()).select("entity_id", "prop", "value").distinct()


def _joined(entities: DataFrame, tables: list[DataFrame]) -> DataFrame:
    for table in tables:
        entities = entities.join(table.hint("merge"), "entity_id", "left")
    return entities


def widen(statements: DataFrame, schema_props: DataFrame, block: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per entity with a live record: ``entity_id`` and a typed column per attribute."""
    spark = statements.sparkSession
    props = attributes(schema_props)
    block = block or max(BLOCK, -(-len(props) // MAX_BLOCKS))
    names = column_names(props)
    buckets = buckets or shuffle_partitions(spark)
    scratch = Scratch(spark, "widen")
    records = scratch.stage(live_records(statements).where("entity_id is not null"), "records")
    blocks = [props[i : i + block] for i in range(0, len(props), block)]
    block_of = F.when(F.lit(False), -1)
    for i, b in enumerate(blocks):
        block_of = block_of.when(F.col("prop").isin([p for p, _, _ in b]), i)
    filled = cells(records, props).withColumn("block", block_of)
    everyone = records.select("entity_id").distinct().select("entity_id", F.lit("").alias("prop"), F.lit(None).cast("string").alias("cell"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("block"))
    stored = scratch.stage_bucketed(filled.unionByName(everyone), "entity_id", buckets, "block")
    entities = stored.where("block = -1").select("entity_id")
    tables = []
    for i, b in enumerate(blocks):
        columns = []
        for prop, kind, many in b:
            here = F.col("prop") == prop
            columns.append(F.max(F.when(here, F.col("cell"))).cast(TYPES[kind]).alias(names[prop]))
            if many:
                columns.append(F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"{names[prop]}__n"))
        tables.append(stored.where(F.col("block") == i).groupBy("entity_id").agg(*columns))
    while len(tables) > JOINED:
        groups = [tables[i : i + JOINED] for i in range(0, len(tables), JOINED)]
        tables = [scratch.keep_bucketed(_joined(entities, group), "entity_id", buckets) for group in groups]
    wide = _joined(entities, tables)
    counts = [f"{names[p]}__n" for p, _, m in props if m]
    return wide.fillna(0, counts) if counts else wide


def typed_cells(wide: DataFrame, props: list[tuple[str, str, bool]]) -> DataFrame:
    """The filled date, decimal and integer cells of a wide table: ``entity_id, prop, cell``."""
    names = column_names(props)
    typed = [(p, names[p]) for p, t, _ in props if t in PARSERS]
    if not typed:
        return wide.select("entity_id", F.lit("").alias("prop"), F.lit("").alias("cell")).limit(0)
    pairs = F.array(*[F.struct(F.lit(p).alias("prop"), F.col(f"`{c}`").cast("string").alias("cell")) for p, c in typed])
    return wide.select("entity_id", F.explode(pairs).alias("c")).select("entity_id", "c.prop", "c.cell").where("cell is not null")


def all_cells(wide: DataFrame, props: list[tuple[str, str, bool]]) -> DataFrame:
    """Everything a wide table holds, in long form: ``entity_id, prop, cell`` (as text) and ``n``, the number of values of attributes that allow several."""
    names = column_names(props)
    if not props:
        return wide.select("entity_id", F.lit("").alias("prop"), F.lit("").alias("cell"), F.lit(0).cast("long").alias("n")).limit(0)
    count = lambda p, many: F.col(f"`{names[p]}__n`") if many else F.lit(None).cast("long")
    pairs = F.array(*[F.struct(F.lit(p).alias("prop"), F.col(f"`{names[p]}`").cast("string").alias("cell"), count(p, many).alias("n")) for p, _, many in props])
    return wide.select("entity_id", F.explode(pairs).alias("c")).select("entity_id", "c.prop", "c.cell", "c.n").where("cell is not null")
