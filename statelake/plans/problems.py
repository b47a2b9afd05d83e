"""Queries of the data-processing problems, over whole tables, and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.operators import cells, changes, deliveries, hierarchy, increments, skew, smallfiles, widen
from statelake.session import Scratch, shuffle_partitions, table

HEAVY = (("entity_id", 0.02), ("shard", 0.10))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.repeated_messages(table(spark, sf_dir, "journal")).select("id", "origin", "fragment")


def p1_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.dedupe_messages(table(spark, sf_dir, "journal")).select("message_no", "segment_no", "entity_id", "prop", "value", "last_seen", "deleted_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = table(spark, sf_dir, "statements")
    entity, shard = [
        skew.heavy_keys(skew.key_states(statements, field, "last_seen", "row_no"), share).select(F.lit(field).alias("field"), "key_value") for field, share in HEAVY
    ]
    return entity.unionByName(shard)


def p2_entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_states(table(spark, sf_dir, "statements"), "entity_id", "last_seen", "row_no")


def p2_shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_states(table(spark, sf_dir, "statements"), "shard", "last_seen", "row_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "schema_props")
    return widen.typed_cells(widen.widen(table(spark, sf_dir, "statements"), registry), widen.attributes(registry))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen.widen(table(spark, sf_dir, "statements"), table(spark, sf_dir, "schema_props"))


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that ``p3_wide`` holds, in long form, so that SQL can say the same."""
    registry = table(spark, sf_dir, "schema_props")
    return widen.all_cells(widen.widen(table(spark, sf_dir, "statements"), registry), widen.attributes(registry))


def p3_many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "schema_props")
    return widen.many_values(widen.live_records(table(spark, sf_dir, "statements")), widen.attributes(registry))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_of(table(spark, sf_dir, "folders"), table(spark, sf_dir, "files"))


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve(hierarchy.newest_nodes(table(spark, sf_dir, "folders")))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree_with_files(table(spark, sf_dir, "folders"), table(spark, sf_dir, "files"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every folder and file: root, depth and full path."""
    return _nodes(spark, sf_dir).select("id", "root_id", "depth", F.when(F.col("depth") >= 0, hierarchy.path_text()).alias("full_path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder and file below each folder."""
    return hierarchy.descendants(_nodes(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of folders and files below each folder that has any."""
    return hierarchy.descendant_counts(_nodes(spark, sf_dir))


def p4_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).where("depth < 0").select("id", F.col("root_id").alias("loop_id"))


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole compaction of the small files of ``statements``."""
    scratch = Scratch(spark, "smallfiles")
    return smallfiles.compact_rows(table(spark, sf_dir, "statement_files"), table(spark, sf_dir, "statements"), scratch.path("compacted"), shuffle_partitions(spark) * 2, scratch)


def p5_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file consumed and the rows that were copied of it."""
    return compaction(spark, sf_dir).select("file_no", "rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that validated copies have consumed."""
    return compaction(spark, sf_dir).select("file_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increments.increment_after_runs(table(spark, sf_dir, "statements"), table(spark, sf_dir, "export_runs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf_dir, "statement_changes")).select("id", "origin", "fragment")


def p7_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf_dir, "statement_changes"))


QUERIES = (
    p1_found, p1_deduped, p2_found, p2_entity_states, p2_shard_states, p3_found, p3_wide, p3_cells, p3_many_values, p4_found, p4_paths, p4_descendants, p4_counts,
    p4_loops, p5_found, p5_compacted, p6_found, p7_found, p7_state,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MESSAGE = "lower(regexp_replace(id, '^\\s+|\\s+$', '', 'g'))"
_LIVE = """
    newest AS (SELECT id, origin, coalesce(fragment, '') AS fragment, max(last_seen) AS m FROM statements GROUP BY ALL),
    live AS (SELECT s.id, s.origin, coalesce(s.fragment, '') AS fragment, max(s.entity_id) AS entity_id, max(s.prop) AS prop, max(s.value) AS value
             FROM statements s JOIN newest n ON s.id = n.id AND s.origin = n.origin AND coalesce(s.fragment, '') = n.fragment AND s.last_seen = n.m
             GROUP BY 1, 2, 3 HAVING count(s.deleted_at) = 0)"""
_WIDTHS = f"translate(value, {sql_text(cells.FULL_WIDTH)}, {sql_text(cells.ASCII)})"
_CELLS = r"""
    kinds AS (SELECT DISTINCT prop, cell_type FROM schema_props WHERE cell_type <> 'string' AND prop <> 'id'),
    said AS (SELECT DISTINCT entity_id, l.prop, cell_type, trim(regexp_replace(regexp_replace({value}, '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{AD}]', '', 'g'),
                 '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS t
             FROM live l JOIN kinds k ON l.prop = k.prop WHERE value IS NOT NULL AND entity_id IS NOT NULL),
    day AS (SELECT entity_id, prop, lower(regexp_replace(t, '^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})[Tt ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?$', '\1')) AS d FROM said WHERE cell_type = 'date'),
    word AS (SELECT *, replace(trim(regexp_replace(regexp_replace(d, '(\d)(st|nd|rd|th)', '\1'), '[-., ]+', ' ', 'g')), 'sept ', 'sep ') AS w FROM day),
    date_cells AS (SELECT entity_id, prop, strftime(CASE
        WHEN regexp_full_match(d, '\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}') THEN try_strptime(translate(d, '/.', '--'), '%Y-%m-%d')
        WHEN regexp_full_match(d, '\d{8}') THEN try_strptime(d, '%Y%m%d')
        WHEN regexp_full_match(d, '\d{1,2}\. ?\d{1,2}\. ?\d{4}') THEN try_strptime(replace(d, ' ', ''), '%d.%m.%Y')
        WHEN regexp_full_match(d, '\d{1,2}(st|nd|rd|th|\.)?[ -][a-z]+\.?,?[ -]\d{4}') THEN try_strptime(w, ['%d %B %Y', '%d %b %Y'])
        WHEN regexp_full_match(d, '[a-z]+\.? \d{1,2}(st|nd|rd|th)?,? \d{4}') THEN try_strptime(w, ['%B %d %Y', '%b %d %Y']) END, '%Y-%m-%d') AS cell FROM word),
    money AS (SELECT entity_id, prop, cell_type, translate(CASE WHEN cell_type = 'decimal' THEN trim(regexp_replace(regexp_replace(t, '(?i)^(EUR|USD|GBP|CHF|€|\$|£) ?', ''), '(?i)(\d) ?(EUR|USD|GBP|CHF|€|\$|£)$', '\1')) ELSE t END, '’−', '''-') AS m
              FROM said WHERE cell_type <> 'date'),
    digits AS (SELECT entity_id, prop, cell_type, CASE WHEN m[1] = '-' THEN '-' ELSE '' END AS sign, regexp_replace(m, '^[+-] ?', '') AS b FROM money),
    numbers AS (SELECT entity_id, prop, cell_type, sign || replace(regexp_replace(regexp_replace(b, '[.,](\d{1,2})$', '#\1'), '[ ,.'']', '', 'g'), '#', '.') AS n FROM digits
                WHERE regexp_full_match(b, '\d+([.,]\d{1,2})?|[1-9]\d{0,2}(,\d{3})+(\.\d{1,2})?|[1-9]\d{0,2}(\.\d{3})+(,\d{1,2})?|[1-9]\d{0,2}( \d{3})+([.,]\d{1,2})?|[1-9]\d{0,2}(''\d{3})+([.,]\d{1,2})?')),
    found AS (SELECT entity_id, prop, cell FROM date_cells
              UNION ALL SELECT entity_id, prop, try_cast(n AS DECIMAL(38, 2))::VARCHAR FROM numbers WHERE cell_type = 'decimal'
              UNION ALL SELECT entity_id, prop, try_cast(regexp_replace(n, '\.0+$', '') AS DECIMAL(38, 0))::VARCHAR FROM numbers WHERE cell_type = 'integer' AND NOT regexp_matches(n, '\.\d*[1-9]'))
    """.replace("{value}", _WIDTHS)
_STATES = """
    SELECT key_value, count(*) AS n, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us, coalesce(max(gap), 0) AS max_gap_us
    FROM (SELECT {key} AS key_value, last_seen AS t, epoch_us(last_seen) - epoch_us(lag(last_seen) OVER (PARTITION BY {key} ORDER BY last_seen)) AS gap FROM statements)
    GROUP BY 1"""
_FILES = """
    last AS (SELECT file_no, max(table_version) AS v FROM statement_files GROUP BY 1),
    live AS (SELECT DISTINCT f.file_no, shard, bucket, origin, size_bytes FROM statement_files f JOIN last l ON f.file_no = l.file_no AND f.table_version = l.v
             WHERE f.file_no NOT IN (SELECT g.file_no FROM statement_files g JOIN last k ON g.file_no = k.file_no AND g.table_version = k.v WHERE g.action <> 'add')),
    small AS (SELECT *, count(*) OVER (PARTITION BY shard, bucket, origin) AS k FROM live WHERE size_bytes < 16384)"""
_TREE = """
    latest AS (SELECT id, arg_max(parent, updated_at) AS parent, arg_max(fileName, updated_at) AS name FROM folders GROUP BY id),
    node AS (SELECT a.id, b.id AS parent, a.name FROM latest a LEFT JOIN latest b ON a.parent = b.id),
    walk AS (SELECT id, id AS root_id, 0::BIGINT AS depth, name AS full_path, [id] AS ids FROM node WHERE parent IS NULL
             UNION ALL SELECT n.id, w.root_id, w.depth + 1, w.full_path || '/' || n.name, list_append(w.ids, n.id) FROM node n JOIN walk w ON n.parent = w.id)"""
_LOOPS = """
    climb AS (SELECT id AS start, parent AS up, [id] AS seen FROM node WHERE id NOT IN (SELECT id FROM walk)
              UNION ALL SELECT c.start, n.parent, list_append(c.seen, c.up) FROM climb c JOIN node n ON n.id = c.up WHERE NOT list_contains(c.seen, c.up)),
    loops AS (SELECT start AS id, list_min(list_slice(seen, list_position(seen, up), len(seen))) AS loop_id FROM climb WHERE list_contains(seen, up))"""
_NODES = """
    steps AS (SELECT id, list_filter(string_split(replace(arg_max(key, (updated_at, key)), '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS steps FROM files GROUP BY id),
    spot AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY full_path ORDER BY root_id, depth, id) = 1),
    hung AS (SELECT s.id, coalesce(p.root_id, s.id) AS root_id, coalesce(p.depth + 1, 0) AS depth, concat_ws('/', p.full_path, coalesce(steps[-1], '')) AS full_path,
                    list_append(coalesce(p.ids, []), s.id) AS ids
             FROM steps s LEFT JOIN spot p ON len(steps) > 1 AND array_to_string(steps[:-2], '/') = p.full_path WHERE s.id NOT IN (SELECT id FROM latest)),
    nodes AS (SELECT id, root_id, depth, full_path, ids FROM walk UNION ALL SELECT id, root_id, depth, full_path, ids FROM hung)"""
_CHANGES = """
    n AS (SELECT *, rank() OVER (PARTITION BY id, origin, fragment ORDER BY last_seen DESC) AS r,
                 max(last_seen) OVER (PARTITION BY origin, entity_id, prop, fragment) AS g FROM statement_changes),
    k AS (SELECT id, origin, fragment, bool_or(deleted_at IS NOT NULL) AS dead, bool_or(last_seen = g) AS newest FROM n WHERE r = 1 GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can state; the others are tested on fixtures."""
    return {
        "p1_found": f"SELECT {_MESSAGE} AS id, origin, coalesce(fragment, '') AS fragment FROM journal GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "p1_deduped": f"""
            SELECT message_no, segment_no, entity_id, prop, value, last_seen, deleted_at
            FROM (SELECT *, row_number() OVER (PARTITION BY {_MESSAGE}, origin, coalesce(fragment, '') ORDER BY received_at, message_no) AS r FROM journal) WHERE r = 1""",
        "p2_found": """
            SELECT 'entity_id' AS field, entity_id AS key_value FROM statements GROUP BY 2 HAVING count(*) > 0.02 * (SELECT count(*) FROM statements)
            UNION ALL SELECT 'shard', shard FROM statements GROUP BY 2 HAVING count(*) > 0.10 * (SELECT count(*) FROM statements)""",
        "p2_entity_states": _STATES.format(key="entity_id"),
        "p2_shard_states": _STATES.format(key="shard"),
        "p3_found": f"WITH {_LIVE}, {_CELLS} SELECT entity_id, prop, min(cell) AS cell FROM found WHERE cell IS NOT NULL GROUP BY ALL",
        "p3_cells": f"""
            WITH {_LIVE}, {_CELLS},
            texts AS (SELECT entity_id, l.prop, value AS cell FROM live l WHERE value IS NOT NULL AND entity_id IS NOT NULL AND prop IN (SELECT prop FROM schema_props WHERE cell_type = 'string' AND prop <> 'id')),
            several AS (SELECT prop, bool_or(many) AS many FROM schema_props GROUP BY 1)
            SELECT entity_id, c.prop, min(cell) AS cell, CASE WHEN any_value(many) THEN count(DISTINCT cell) END AS n
            FROM (SELECT * FROM found UNION ALL SELECT * FROM texts) c JOIN several s ON c.prop = s.prop WHERE cell IS NOT NULL GROUP BY 1, 2""",
        "p3_many_values": f"WITH {_LIVE} SELECT DISTINCT entity_id, prop, value FROM live WHERE prop IN (SELECT prop FROM schema_props WHERE many) AND value IS NOT NULL",
        "p4_found": f"""
            WITH RECURSIVE {_TREE}, {_LOOPS},
            fk AS (SELECT id, list_filter(string_split(replace(arg_max(key, updated_at), '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS steps FROM files GROUP BY id),
            place AS (SELECT full_path, min(root_id) AS root_id, min(depth) AS depth FROM walk GROUP BY 1)
            SELECT id, root_id, depth FROM walk UNION ALL SELECT id, loop_id, -1 FROM loops
            UNION ALL SELECT fk.id, coalesce(p.root_id, fk.id), coalesce(p.depth + 1, 0) FROM fk LEFT JOIN place p ON len(steps) > 1 AND array_to_string(steps[:-2], '/') = p.full_path""",
        "p4_paths": f"""
            WITH RECURSIVE {_TREE}, {_LOOPS}, {_NODES} SELECT id, root_id, depth, full_path FROM nodes UNION ALL SELECT id, loop_id, -1, NULL FROM loops""",
        "p4_descendants": f"""
            WITH RECURSIVE {_TREE}, {_NODES} SELECT u AS id, id AS descendant, depth - list_position(ids, u) + 1 AS distance FROM (SELECT id, depth, ids, unnest(ids[:-2]) AS u FROM nodes)""",
        "p4_counts": f"WITH RECURSIVE {_TREE}, {_NODES} SELECT u AS id, count(*) AS descendants FROM (SELECT unnest(ids[:-2]) AS u FROM nodes) GROUP BY 1",
        "p4_loops": f"WITH RECURSIVE {_TREE}, {_LOOPS} SELECT id, loop_id FROM loops",
        "p5_found": f"WITH {_FILES} SELECT file_no FROM small WHERE k > 1",
        "p5_compacted": f"WITH {_FILES} SELECT s.file_no, count(t.row_no) AS rows FROM small s LEFT JOIN statements t ON s.file_no = t.file_no WHERE k > 1 GROUP BY 1",
        "p6_found": """
            WITH covered AS (SELECT DISTINCT b FROM (SELECT unnest(range(from_batch, to_batch + 1)) AS b FROM export_runs WHERE kind = 'entities' AND status = 'ok')),
            rec AS (SELECT id, origin, fragment, entity_id, min(batch_no) AS b1, min(batch_no) FILTER (WHERE deleted_at IS NOT NULL) AS b2,
                           arg_max(deleted_at IS NULL, (last_seen, deleted_at IS NOT NULL)) AS live FROM statements GROUP BY ALL)
            SELECT entity_id, CASE WHEN bool_or(live) THEN 'ADD' ELSE 'DEL' END AS op FROM rec GROUP BY 1
            HAVING bool_or(b1 NOT IN (SELECT b FROM covered) OR (b2 IS NOT NULL AND b2 NOT IN (SELECT b FROM covered)))""",
        "p7_state": f"""
            WITH {_CHANGES},
            i AS (SELECT id, origin, coalesce(fragment, '') AS fragment, entity_id, prop, value, first_seen, last_seen, deleted_at FROM statement_changes
                  QUALIFY row_number() OVER (PARTITION BY id, origin, coalesce(fragment, '') ORDER BY last_seen DESC NULLS LAST, (deleted_at IS NOT NULL) DESC,
                  entity_id DESC NULLS LAST, prop DESC NULLS LAST, value DESC NULLS LAST, first_seen DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1)
            SELECT i.* FROM i JOIN k ON i.id = k.id AND i.origin = k.origin AND i.fragment = k.fragment WHERE NOT k.dead AND (k.fragment = '' OR k.newest)""",
        "p7_found": f"WITH {_CHANGES} SELECT id, origin, fragment FROM k WHERE NOT dead AND (fragment = '' OR newest)",
    }
