"""Queries of the engine's own operators, over whole tables, each with a DuckDB statement that gives the same rows.

``statements`` is the raw append log, ``journal`` the buffered one, ``folders``
and ``files`` the archive; company and payment payloads come from the sales tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statelake.functions import ids
from statelake.functions import values as rules
from statelake.operators import assemble as asm
from statelake.operators import documents as docs
from statelake.operators import asof, checksums, feeds, hierarchy, smallfiles, stats
from statelake.operators import merge as mrg
from statelake.plans.query import C, Compiler, G, M, P, Query, parse_flat, parse_rql
from statelake.registry import Registry
from statelake.schema import NAMES, conform, live_view, raw_view
from statelake.session import Scratch, table
from statelake.sources import files as fmt
from statelake.sources.paths import Folder
from statelake.sources.store import StatementStore
from statelake.streaming import journal as jr

CUTOFF = "2024-09-01 00:00:00"
SINCE = "2024-11-01 00:00:00"
LEAST_SLICES = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables, and what every query derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return raw_view(conform(self.statements, naive=True))

    @cached_property
    def merged(self) -> DataFrame:
        return mrg.merge(self.raw)

    @cached_property
    def kept(self) -> DataFrame:
        """The merged rows as a table, for what reads them more than once."""
        return Scratch(self.spark, "merged").stage(self.merged, "rows")

    @cached_property
    def live(self) -> DataFrame:
        return live_view(self.merged)

    @cached_property
    def registry(self) -> Registry:
        return Registry.from_props(self.schema_props)

    @cached_property
    def compiler(self) -> Compiler:
        return Compiler(self.registry, 16)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- pieces of the DuckDB statements

_TIES = ", ".join(f"{c} DESC NULLS LAST" for c in mrg.TIES)
_A = "PARTITION BY shard, bucket, origin, id"
_G = "PARTITION BY shard, bucket, origin, entity_id, prop, fragment"
RAW = "raw AS (SELECT * REPLACE (coalesce(fragment, '') AS fragment) FROM statements)"
MERGED = f"""{RAW},
    a AS (SELECT * REPLACE (min(first_seen) OVER ({_A}) AS first_seen) FROM raw WHERE fragment = '' QUALIFY row_number() OVER ({_A} ORDER BY {_TIES}) = 1),
    b AS (SELECT * REPLACE (min(first_seen) OVER ({_G}, id) AS first_seen) FROM raw WHERE fragment <> ''
          QUALIFY last_seen = max(last_seen) OVER ({_G}) AND row_number() OVER ({_G}, id ORDER BY {_TIES}) = 1),
    merged AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    live AS (SELECT *, entity_id AS canonical_id FROM merged WHERE deleted_at IS NULL)"""
_CORE = "id, entity_id, origin, prop, value, fragment, first_seen, last_seen, deleted_at"
CORE = _CORE.split(", ")


def ordered(list_sql: str) -> str:
    return f"list_sort({list_sql}, 'ASC', 'NULLS FIRST')"


# ---- scans and projections


@query(f"SELECT {_CORE} FROM statements")
def raw_scan(t):
    return t.raw.select(*CORE)


@query("SELECT id, entity_id, entity_id AS canonical_id, prop, value, first_seen FROM statements WHERE deleted_at IS NULL")
def live_view_scan(t):
    return live_view(t.raw).select("id", "entity_id", "canonical_id", "prop", "value", "first_seen")


@query(f"""WITH {MERGED} SELECT id, entity_id, canonical_id, prop, prop_type, schema, value, original_value, dataset, origin, lang, external,
    strftime(first_seen, '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%S') AS last_seen, fragment FROM live""")
def csv_projection(t):
    return fmt.csv_projection(t.live)


@query(f"SELECT {_CORE} FROM statements WHERE entity_id >= 'com-' AND entity_id < 'per-'")
def range_slice(t):
    return t.raw.where((F.col("entity_id") >= "com-") & (F.col("entity_id") < "per-")).select(*CORE)


@query(f"SELECT {_CORE} FROM statements WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '{CUTOFF}'")
def grace_filter(t):
    return mrg.reap(t.raw, CUTOFF).select(*CORE)


@query("SELECT DISTINCT entity_id, lower(format('{:x}', cast('0x' || substr(sha1(entity_id), 1, 8) AS BIGINT) % 16)) AS shard FROM statements")
def shard_assign(t):
    return t.raw.select("entity_id", ids.entity_shard(F.col("entity_id"), 16).alias("shard")).distinct()


@query("SELECT id, entity_id, value FROM statements WHERE bucket = 'document'")
def bucket_prune(t):
    return t.raw.where("bucket = 'document'").select("id", "entity_id", "value")


@query("SELECT id, entity_id, value FROM statements WHERE shard IN ('1', 'c')")
def shard_prune(t):
    return t.raw.where(F.col("shard").isin("1", "c")).select("id", "entity_id", "value")


@query("SELECT DISTINCT shard, bucket, origin FROM statements")
def partition_listing(t):
    return t.raw.select("shard", "bucket", "origin").distinct().orderBy("shard", "bucket", "origin")


@query("""WITH last AS (SELECT *, max(table_version) OVER (PARTITION BY file_no) AS v FROM statement_files WHERE file_no IS NOT NULL),
    live AS (SELECT file_no, max(shard) AS shard, max(bucket) AS bucket, max(origin) AS origin, max(size_bytes) AS size FROM last WHERE table_version = v GROUP BY 1 HAVING bool_and(action = 'add'))
    SELECT shard, bucket, origin, sum(size)::BIGINT AS bytes, count(*) AS files FROM live GROUP BY ALL""")
def partition_sizes(t):
    return smallfiles.live_files(t.statement_files).groupBy("shard", "bucket", "origin").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


# ---- identity


def made_id(dataset: str, entity: str, prop: str, value: str, external: str = "false", lang: str = "NULL") -> str:
    """The statement id in DuckDB."""
    sized = ", ".join(f"length({c}), {c}" for c in (dataset, entity, prop))
    return f"sha1(concat_ws('|', {sized}, CASE WHEN {external} THEN 1 ELSE 0 END, coalesce(length({lang}), -1), coalesce({lang}, ''), {value}))"


@query(f"SELECT row_no, {made_id('dataset', 'entity_id', 'prop', 'value', 'external', 'lang')} AS made FROM statements WHERE value IS NOT NULL AND entity_id IS NOT NULL AND prop IS NOT NULL")
def statement_id(t):
    made = ids.statement_id(*[F.col(c) for c in ("dataset", "entity_id", "prop", "value", "external", "lang")])
    return t.statements.select("row_no", made.alias("made")).where("made is not null")


@query("SELECT entity_id, sha1(min(schema) || string_agg(DISTINCT id, '' ORDER BY id)) AS checksum FROM statements WHERE deleted_at IS NULL GROUP BY 1")
def base_checksum(t):
    return checksums.entity_checksums(t.raw.where("deleted_at is null"))


@query("SELECT row_no, id || chr(9) || origin || chr(9) || coalesce(fragment, '') AS k FROM statements")
def dedupe_key(t):
    return t.statements.select("row_no", ids.dedupe_key(F.col("id"), F.col("origin"), F.col("fragment")).alias("k"))


@query("SELECT row_no, 'file-' || sha256(key || checksum) AS made FROM files")
def file_id(t):
    return t.files.select("row_no", ids.file_id(F.col("key"), F.col("checksum")).alias("made"))


@query("SELECT row_no, 'folder-' || sha256(coalesce(parent, '') || fileName) AS made FROM folders")
def folder_id(t):
    return t.folders.select("row_no", ids.folder_id(F.col("fileName"), F.col("parent")).alias("made"))


@query("""SELECT row_no, CASE WHEN regexp_full_match(checksum, '[0-9a-f]{64}') THEN
          concat_ws('/', 'archive', checksum[1:2], checksum[3:4], checksum[5:6], checksum, 'blob') END AS key FROM files""")
def blob_key(t):
    return t.files.select("row_no", ids.blob_key(F.col("checksum")).alias("key"))


@query("""SELECT row_no, CASE WHEN regexp_full_match(b, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN b END AS bare
          FROM (SELECT row_no, regexp_replace(trim(entity_id), '\\.[^.]*$', '') AS b FROM statements)""")
def strip_namespace(t):
    return t.statements.select("row_no", ids.strip_namespace(F.col("entity_id")).alias("bare"))


_MIME = "lower(trim(regexp_replace(mimetype, ';.*$', '')))"


@query(f"""SELECT row_no, CASE WHEN m IN ('application/pdf', 'application/msword', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') THEN 'Pages'
    WHEN m IN ('text/html', 'text/xml', 'application/xml') THEN 'HyperText' WHEN m IN ('text/plain', 'text/rtf', 'application/rtf') THEN 'PlainText'
    WHEN m IN ('text/csv', 'application/vnd.ms-excel', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet') THEN 'Table'
    WHEN m IN ('message/rfc822', 'application/vnd.ms-outlook', 'application/oebps-package+xml') THEN 'Email'
    WHEN m IN ('image/jpeg', 'image/png', 'image/gif', 'image/tiff', 'image/vnd.djvu', 'image/vnd.adobe.photoshop') THEN 'Image' ELSE 'Document' END AS schema,
    coalesce(nullif(m, ''), 'application/octet-stream') AS mime FROM (SELECT row_no, {_MIME} AS m FROM files)""")
def mime_rules(t):
    return t.files.select("row_no", rules.mime_schema(F.col("mimetype")).alias("schema"), rules.pick_mime(F.array("mimetype")).alias("mime"))


@query("SELECT row_no, 'https://data.example.org/' || dataset || '/' || checksum AS url, concat_ws('/', nullif(regexp_replace(key, '/?[^/]*$', ''), ''), name) AS relative FROM files")
def public_urls(t):
    path = F.regexp_replace("key", "/?[^/]*$", "").alias("path")
    rows = t.files.select("row_no", "name", path, rules.public_url("https://data.example.org/${dataset}", F.col("dataset"), F.col("checksum")).alias("url"))
    return rows.select("row_no", "url", docs.relative_path().alias("relative"))


@query("SELECT row_no, length(trim(origin)) > 0 AND length(origin) <= 255 AND NOT contains(origin, '..') AND origin <> '.' AND NOT regexp_matches(origin, '[/\\\\\\x00-\\x1f\\x7f]') AS ok FROM statements")
def origin_guard(t):
    return t.statements.select("row_no", rules.is_safe_name(F.col("origin")).alias("ok"))


# ---- payloads and imports

_COMPANIES = """
    p AS (SELECT 'cust-' || c_custkey AS entity_id, c_name AS name, n_name AS jurisdiction FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT entity_id, 'name' AS prop, 'name' AS prop_type, name AS value FROM p UNION ALL SELECT entity_id, 'jurisdiction', 'country', jurisdiction FROM p),
    i AS (SELECT *, {id} AS id FROM s)""".replace("{id}", made_id("'sales'", "entity_id", "prop", "value"))


@query(f"""WITH {_COMPANIES}, k AS (SELECT entity_id, sha1('Company' || string_agg(id, '' ORDER BY id)) AS value FROM i GROUP BY 1)
    SELECT *, 'thing' AS bucket, 'sales' AS origin, TIMESTAMP '2024-01-01' AS first_seen, TIMESTAMP '2024-01-01' AS last_seen FROM
    (SELECT entity_id, prop, prop_type, value, id FROM i UNION ALL SELECT entity_id, 'id', 'checksum', value, {made_id("'sales'", "entity_id", "'id'", "value")} FROM k)""")
def explode_entities(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    payload = rows.select(
        F.concat(F.lit("cust-"), "c_custkey", F.lit(".f00d")).alias("id"),
        F.lit("Company").alias("schema"),
        F.create_map(F.lit("name"), F.array("c_name", F.lit(""), "c_name"), F.lit("jurisdiction"), F.array("n_name"), F.lit("bogus"), F.array("c_name")).alias("properties"),
    )
    made = asm.explode(payload, t.registry, "sales", 16, "2024-01-01", "sales")
    dates = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")]
    return made.select("entity_id", "prop", "prop_type", "value", "id", "bucket", "origin", *dates)


_LANG = """CASE WHEN CASE WHEN prop = 'id' THEN 'checksum' ELSE coalesce(known, prop_type) END IN ('date', 'number', 'country', 'entity', 'checksum', 'mimetype', 'identifier', 'language', 'url') THEN NULL ELSE lang END"""


@query(f"""SELECT row_no, coalesce(origin, 'x') AS origin, {made_id("'copy'", "entity_id", "prop", "value", "external", _LANG)} AS id,
    coalesce(first_seen, TIMESTAMP '2024-01-01') AS first_seen FROM (SELECT s.*, (SELECT max(p.prop_type) FROM schema_props p WHERE p.schema = s.schema AND p.prop = s.prop) AS known FROM statements s)
    WHERE entity_id IS NOT NULL AND prop IS NOT NULL AND value IS NOT NULL""")
def csv_row_map(t):
    # the row number travels as the source's canonical id would: as text
    text = t.statements.select(*[F.col(c).cast("string").alias(c) for c in fmt.CSV_COLUMNS if c != "canonical_id"], F.col("row_no").cast("string").alias("canonical_id"))
    made = fmt.statements_from_csv(text.withColumn("original_value", F.col("canonical_id")), t.registry, "copy", 16, "2024-01-01")
    return made.select(F.col("original_value").cast("long").alias("row_no"), "origin", "id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query("SELECT id, origin, fragment, value, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY id, origin, fragment ORDER BY row_no DESC) AS r FROM statements) WHERE r = 1")
def batch_dedupe_last_wins(t):
    return mrg.last_wins(t.statements.select("row_no", *NAMES), "row_no").select("id", "origin", "fragment", "value", "last_seen")


@query("SELECT row_no, coalesce(NULL, origin, 'fallback') AS origin FROM files")
def origin_resolution(t):
    return t.files.select("row_no", rules.resolve_origin(None, F.col("origin"), "fallback").alias("origin"))


# ---- merge


@query(f"WITH {MERGED} SELECT {_CORE}, original_value, lang FROM merged")
def merge_full(t):
    return t.merged.select(*CORE, "original_value", "lang")


@query(f"WITH {MERGED} SELECT {_CORE} FROM a")
def merge_nonfragment(t):
    return mrg.merge(t.raw.where("coalesce(fragment, '') = ''")).select(*CORE)


@query(f"WITH {MERGED} SELECT {_CORE} FROM b")
def merge_fragment(t):
    return mrg.merge(t.raw.where("fragment <> ''")).select(*CORE)


@query(f"WITH {MERGED} SELECT {_CORE} FROM merged")
def merge_idempotent(t):
    return mrg.merge(t.merged).select(*CORE)


@query(f"WITH {MERGED} SELECT {_CORE} FROM merged")
def merge_by_windows(t):
    return mrg.merge_by_windows(t.raw).select(*CORE)


@query(f"WITH {MERGED} SELECT m.id, m.origin, m.fragment, m.first_seen FROM merged m WHERE m.first_seen < m.last_seen")
def merge_first_seen_fold(t):
    return t.merged.where("first_seen < last_seen").select("id", "origin", "fragment", "first_seen")


@query(f"WITH {MERGED} SELECT {_CORE} FROM merged WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '{CUTOFF}'")
def tombstone_reap(t):
    return mrg.merge(t.raw, CUTOFF).select(*CORE)


@query(f"WITH {MERGED} SELECT {_CORE} FROM merged")
def merge_range_sliced(t):
    """As many slices as an executor's memory asks for, but at least ``LEAST_SLICES``, so that small tables are sliced too."""
    size = sum(n for _, n in Folder(t.spark, t.dir).walk("statements.parquet"))
    memory = t.spark.sparkContext.getConf().get("spark.executor.memory", "8g").lower().removesuffix("b") + "b"
    return mrg.merge_sliced(t.raw, max(LEAST_SLICES, mrg.slice_count(size, memory))).select(*CORE)


# ---- entity queries


def rows_of(condition: str) -> str:
    """Live rows of the entities that satisfy an aggregate condition."""
    return f"WITH {MERGED} SELECT id, entity_id, prop, value, origin, fragment FROM live WHERE entity_id IN (SELECT entity_id FROM live GROUP BY 1 HAVING {condition})"


def found(t, q: Query) -> DataFrame:
    return t.compiler.statements(t.live, q).select("id", "entity_id", "prop", "value", "origin", "fragment")


@query(rows_of("bool_or(schema = 'Person')"))
def q_eq(t):
    return found(t, Query(M(schema="Person")))


@query(rows_of("bool_or(schema IN ('Person', 'Company'))"))
def q_in(t):
    return found(t, Query(M(schema__in=["Person", "Company"])))


@query(rows_of("NOT bool_or(origin = 'crawl')"))
def q_not(t):
    return found(t, Query(~M(origin="crawl")))


@query(rows_of("bool_or(schema NOT IN ('Pages', 'Email'))"))
def q_not_in(t):
    return found(t, Query(M(schema__not_in=["Pages", "Email"])))


@query(rows_of("bool_or(schema = 'Company') OR bool_or(prop = 'position' AND value LIKE 'D%')"))
def q_or(t):
    return found(t, Query(M(schema="Company") | P(position__like="D%")))


@query(rows_of("bool_or(prop = 'name') AND bool_or(prop = 'country')"))
def q_prop_and(t):
    return found(t, Query(P(name__null=False), P(country__null=False)))


@query(rows_of("NOT bool_or(prop = 'name' AND value IS NOT NULL)"))
def q_prop_null(t):
    return found(t, Query(P(name__null=True)))


@query(rows_of("bool_or(prop = 'name' AND value >= 'M')"))
def q_prop(t):
    return found(t, Query(P(name__gte="M")))


@query(rows_of("bool_or(prop_type = 'country' AND value IN ('de', 'fr', 'DE', 'FR'))"))
def q_group_type(t):
    return found(t, Query(G(countries__in=["de", "fr", "DE", "FR"])))


@query(rows_of("bool_or(schema IN ('Document', 'Folder', 'Pages', 'PlainText', 'HyperText', 'Table', 'Image', 'Email')) AND NOT bool_or(schema = 'Folder') AND bool_or(prop = 'contentHash' AND value IS NOT NULL)"))
def q_schemata(t):
    return found(t, Query(M(schemata="Document"), ~M(schema="Folder"), P(contentHash__null=False)))


@query(rows_of(f"bool_or(first_seen >= TIMESTAMP '{SINCE}')"))
def q_gte(t):
    return found(t, Query(C(first_seen__gte=SINCE)))


@query(rows_of("bool_or(prop = 'name' AND value ILIKE '%an%') AND NOT (bool_or(prop = 'alias' AND ends_with(value, '1')) OR bool_or(prop = 'fileName' AND starts_with(value, '20')))"))
def q_text_comparators(t):
    return found(t, Query(P(name__ilike="%an%"), ~(P(alias__endswith="1") | P(fileName__startswith="20"))))


_SORTED = "SELECT entity_id, min(value) FILTER (WHERE prop = 'name') AS k FROM live GROUP BY 1 HAVING bool_or(schema = 'Person') ORDER BY k ASC NULLS LAST, entity_id"


@query(f"""WITH {MERGED}, s AS ({_SORTED} LIMIT 25)
    SELECT id, live.entity_id, prop, value, origin, fragment, row_number() OVER (ORDER BY k ASC NULLS LAST, live.entity_id, id, origin, fragment) - 1 AS place FROM live JOIN s ON live.entity_id = s.entity_id""")
def q_sort(t):
    """``place`` is where the row came out, so the order itself is compared."""
    return found(t, Query(M(schema="Person")).order_by("name")[:25]).coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"""WITH {MERGED}, s AS (SELECT entity_id AS id, min(value) FILTER (WHERE prop = 'name') AS name FROM live GROUP BY 1 HAVING bool_or(schema = 'Company') ORDER BY name DESC NULLS LAST, id LIMIT 40 OFFSET 5)
    SELECT id, name, row_number() OVER (ORDER BY name DESC NULLS LAST, id) - 1 AS place FROM s""")
def q_sorted_entities(t):
    """Assembled entities come out in the order of the query."""
    q = Query(M(schema="Company")).order_by("name", False)[5:45]
    entities = t.compiler.in_order(asm.assemble(t.compiler.statements(t.live, q), t.registry), q)
    return entities.select("id", F.array_min(F.col("properties")["name"]).alias("name")).coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query(f"WITH {MERGED}, s AS (SELECT DISTINCT entity_id FROM live ORDER BY entity_id LIMIT 20 OFFSET 10) SELECT id, entity_id, prop, value, origin, fragment FROM live WHERE entity_id IN (SELECT entity_id FROM s)")
def q_slice(t):
    return found(t, Query()[10:30])


@query(rows_of("bool_or(schema = 'Person') AND bool_or(prop_type = 'country' AND value = 'de')"))
def q_flat_grammar(t):
    return found(t, parse_flat("filter:schema=Person&filter:group.countries=de"))


@query(rows_of("bool_or(schema = 'Company') OR (bool_or(schema = 'Person') AND NOT bool_or(prop = 'birthDate' AND value IS NOT NULL))"))
def q_rql(t):
    return found(t, parse_rql("or(eq(schema,Company),and(eq(schema,Person),null(birthDate)))"))


@query(f"WITH {MERGED} SELECT count(*) AS entities FROM (SELECT entity_id FROM live GROUP BY 1 HAVING bool_or(schema = 'Person'))")
def q_count(t):
    return t.compiler.count(t.live, Query(M(schema="Person")))


# ---- joins


@query(f"WITH {MERGED} SELECT id, entity_id, value FROM live WHERE entity_id IN (SELECT id FROM files)")
def semi_ids(t):
    return t.live.join(t.files.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", "entity_id", "value")


@query(f"WITH {MERGED} SELECT DISTINCT entity_id FROM merged WHERE entity_id NOT IN (SELECT entity_id FROM live)")
def anti_deleted(t):
    return t.merged.select("entity_id").distinct().join(t.live.select("entity_id"), "entity_id", "left_anti")


_JOURNAL = "SELECT lower(trim(id)) AS id, origin, coalesce(fragment, '') AS fragment, value, last_seen, deleted_at FROM journal"


_REST = [c for c in NAMES if c not in ("id", "origin", "fragment", "last_seen", "deleted_at")]


@query(f"""WITH j AS (SELECT * EXCLUDE (message_no, segment_no, received_at) REPLACE (lower(trim(id)) AS id, coalesce(fragment, '') AS fragment) FROM journal),
    b AS (SELECT {', '.join(NAMES)}, 0 AS p FROM statements UNION ALL SELECT {', '.join(NAMES)}, 1 FROM j)
    SELECT id, origin, fragment, p AS buffered, value, last_seen, deleted_at FROM b QUALIFY row_number() OVER
    (PARTITION BY id, origin, fragment ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ('p', 'last_seen', 'deleted_at', *_REST))}) = 1""")
def override_priority(t):
    buffered = conform(t.journal, naive=True).withColumn("id", F.lower(F.trim("id")))
    out = asm.override(t.raw, buffered)
    known = buffered.select("id", "origin", "fragment", F.lit(1).alias("buffered")).distinct()
    return out.join(known, ["id", "origin", "fragment"], "left").select("id", "origin", "fragment", F.coalesce("buffered", F.lit(0)).alias("buffered"), "value", "last_seen", "deleted_at")


@query(f"WITH {MERGED} SELECT DISTINCT s.entity_id AS payment, s.prop, o.entity_id AS party FROM live s JOIN live o ON s.value = o.entity_id WHERE s.prop IN ('payer', 'beneficiary')")
def ref_traversal(t):
    refs = t.live.where(F.col("prop").isin("payer", "beneficiary")).select(F.col("entity_id").alias("payment"), "prop", F.col("value").alias("party"))
    return refs.join(t.live.select(F.col("entity_id").alias("party")), "party", "left_semi").distinct()


_TREE = """latest AS (SELECT id, arg_max(parent, updated_at) AS parent, arg_max(fileName, updated_at) AS name FROM folders GROUP BY id),
    node AS (SELECT a.id, b.id AS parent, a.name FROM latest a LEFT JOIN latest b ON a.parent = b.id),
    walk AS (SELECT id, name AS path FROM node WHERE parent IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name FROM node n JOIN walk w ON n.parent = w.id)"""


@query(f"WITH RECURSIVE {_TREE} SELECT id, path FROM walk")
def folder_paths_recursive(t):
    """By tree contraction: a number of rounds that is logarithmic in the depth, where recursive SQL takes one per level."""
    return hierarchy.resolve(hierarchy.newest_nodes(t.folders)).where("depth >= 0").select("id", hierarchy.path_text().alias("path"))


_PLACES = """WITH RECURSIVE place(name, parent, k) AS (SELECT r_name, CAST(NULL AS STRING), r_regionkey FROM {region}
    UNION ALL SELECT n.n_name, p.name, CAST(NULL AS INT) FROM {nation} n JOIN place p ON n.n_regionkey = p.k) SELECT name, parent FROM place"""


@query(_PLACES.replace("{region}", "region").replace("{nation}", "nation").replace("AS STRING", "AS VARCHAR"))
def sql_recursive(t):
    return passthrough(t, _PLACES, "region", "nation")


@query(f"""WITH RECURSIVE {MERGED}, {_TREE},
    d AS (SELECT DISTINCT entity_id, value AS parent FROM live WHERE prop = 'parent'),
    hit AS (SELECT DISTINCT d.entity_id, w.path FROM d JOIN walk w ON d.parent = w.id)
    SELECT e.entity_id AS id, hit.path FROM (SELECT DISTINCT entity_id FROM live WHERE prop = 'contentHash') e LEFT JOIN hit ON e.entity_id = hit.entity_id""")
def doc_parent_fanout(t):
    nodes = hierarchy.resolve(hierarchy.newest_nodes(t.folders)).where("depth >= 0").select("id", hierarchy.path_text().alias("path"))
    parents = t.live.where("prop in ('contentHash', 'parent')").groupBy("entity_id").agg(
        F.collect_set(F.when(F.col("prop") == "parent", F.col("value"))).alias("parents"), F.max(F.col("prop") == "contentHash").alias("doc")
    )
    return docs.place(parents.where("doc").select(F.col("entity_id").alias("id"), "parents"), nodes).select("id", "path")


# ---- assembly and statistics

_PAIRS = {f"{a}|{b}": c for a in Registry().parents for b in Registry().parents if (c := Registry().common(a, b))}
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _PAIRS.items()) + "}"
_ENTITY = f"""{MERGED}, m AS (SELECT {_MAP} AS m),
    e AS (SELECT entity_id, list_sort(list(DISTINCT schema)) AS schemata, list_sort(list(DISTINCT dataset)) AS datasets, list_sort(list(DISTINCT origin)) AS origin,
          min(first_seen) FILTER (WHERE prop <> 'id') AS first_seen, max(last_seen) FILTER (WHERE prop <> 'id') AS last_seen, max(first_seen) FILTER (WHERE prop = 'id') AS last_change FROM live GROUP BY 1),
    s AS (SELECT e.*, list_reduce(schemata, lambda x, y: m.m[x || '|' || y]) AS schema FROM e, m),
    v AS (SELECT DISTINCT entity_id, prop, value FROM live WHERE prop <> 'id' AND value IS NOT NULL)"""


def _caption_sql() -> str:
    r = Registry()
    whens = []
    for s in r.parents:
        mins = "".join(f"min(value) FILTER (WHERE prop = '{p}'), " for p in r.captions(s))
        whens.append(f"WHEN '{s}' THEN coalesce({mins}'{r.label(s)}')")
    return "CASE schema " + " ".join(whens) + " END"


@query(f"""WITH {_ENTITY}, p AS (SELECT entity_id, string_agg(prop || '=' || value, '|' ORDER BY prop, value) AS properties FROM v GROUP BY 1)
    SELECT s.entity_id AS id, s.schema, array_to_string(datasets, ',') AS datasets, array_to_string(origin, ',') AS origin, first_seen, last_seen, last_change, coalesce(properties, '') AS properties
    FROM s LEFT JOIN p ON s.entity_id = p.entity_id WHERE s.schema IS NOT NULL""")
def assemble_entities(t):
    flat = F.flatten(F.transform(F.map_entries("properties"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v))))
    return asm.assemble(t.live, t.registry).select(
        "id", "schema", F.array_join("datasets", ",").alias("datasets"), F.array_join("origin", ",").alias("origin"), "first_seen", "last_seen", "last_change", F.array_join(flat, "|").alias("properties")
    )


@query(f"WITH {_ENTITY} SELECT s.entity_id AS id, {_caption_sql()} AS caption FROM s LEFT JOIN v ON s.entity_id = v.entity_id WHERE s.schema IS NOT NULL GROUP BY s.entity_id, s.schema")
def captions(t):
    return asm.assemble(t.live, t.registry).select("id", "caption")


@query(f"WITH {_ENTITY} SELECT entity_id AS id, schema FROM s WHERE schema IS NOT NULL")
def schema_merge(t):
    return t.live.groupBy("entity_id").agg(F.collect_set("schema").alias("s")).select(F.col("entity_id").alias("id"), t.registry.merge_column(F.col("s")).alias("schema")).where("schema is not null")


@query(f"WITH {MERGED} SELECT count(DISTINCT entity_id) AS entities FROM live")
def count_entities(t):
    return stats.count_entities(t.live)


@query(f"""WITH {MERGED} SELECT CASE WHEN schema IN ('Payment', 'Membership') THEN 'intervals' WHEN schema = 'Mention' THEN 'other' ELSE 'things' END AS kind,
    schema, count(DISTINCT entity_id) AS entities FROM live GROUP BY schema""")
def stats_by_schema(t):
    return stats.by_schema(t.live, t.registry)


@query(f"WITH {MERGED} SELECT value, count(DISTINCT entity_id) AS entities FROM live WHERE prop_type = 'country' AND value IS NOT NULL GROUP BY 1")
def stats_facets(t):
    return stats.facets(t.live)


@query(f"WITH {MERGED} SELECT min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS statements, count(DISTINCT entity_id) AS entities FROM live")
def stats_span(t):
    return stats.span(t.live)


# ---- sorts and sets


@query(f"WITH {MERGED} SELECT {_CORE} FROM merged")
def file_sort_order(t):
    return mrg.sorted_for_files(t.merged.repartitionByRange("entity_id")).select(*CORE)


@query("SELECT entity_id, count(*) AS n FROM statements GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 20")
def topk_entities(t):
    return t.raw.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)


@query("SELECT id, entity_id, 'plain' AS branch FROM statements WHERE fragment = '' UNION ALL SELECT id, entity_id, 'fragment' FROM statements WHERE fragment <> ''")
def union_branches(t):
    plain = t.raw.where("fragment = ''").select("id", "entity_id", F.lit("plain").alias("branch"))
    return plain.unionByName(t.raw.where("fragment <> ''").select("id", "entity_id", F.lit("fragment").alias("branch")))


@query("SELECT DISTINCT id FROM (SELECT lower(trim(id)) AS id FROM journal EXCEPT SELECT id FROM statements)")
def id_set_difference(t):
    return t.journal.select(F.lower(F.trim("id")).alias("id")).distinct().join(t.raw.select("id"), "id", "left_anti")


# ---- change feeds and documents

_CHANGED = f"changed AS (SELECT DISTINCT entity_id FROM merged WHERE first_seen >= TIMESTAMP '{SINCE}' OR deleted_at >= TIMESTAMP '{SINCE}')"


@query(f"WITH {MERGED}, {_CHANGED} SELECT entity_id FROM changed")
def diff_changed_ids(t):
    return feeds.changed_ids(t.merged, SINCE)


@query(f"""WITH {MERGED}, {_CHANGED} SELECT CASE WHEN l.entity_id IS NULL THEN 'DEL' ELSE 'ADD' END AS op, c.entity_id AS id, count(DISTINCT l.prop) FILTER (WHERE l.prop <> 'id' AND l.value IS NOT NULL) AS props
    FROM changed c LEFT JOIN live l ON c.entity_id = l.entity_id GROUP BY l.entity_id, c.entity_id""")
def diff_envelopes(t):
    return feeds.diff(t.kept, SINCE, t.registry).select("op", "id", F.coalesce(F.size("entity.properties"), F.lit(0)).cast("long").alias("props")).withColumn("props", F.greatest("props", F.lit(0)))


@query()
def diff_envelope_lines(t):
    """The change feed's JSON lines themselves: whole entities for ADD, ids for DEL. SQL cannot render the same JSON; a test holds them against brute force."""
    return feeds.envelopes(feeds.diff(t.kept, SINCE, t.registry))


def _label_sql() -> str:
    r = Registry()
    return "CASE max(s.schema) " + " ".join(f"WHEN '{d}' THEN '{r.label(d)}'" for d in r.descendants("Document")) + " END"


_NORMAL = "lower(trim(regexp_replace(value, ';.*$', '')))"
_ENDINGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.mime_endings().items()) + "}"
_DOCS = f"""{_ENTITY}, {_TREE},
    d AS (SELECT s.entity_id AS id, min(value) FILTER (WHERE prop = 'contentHash') AS checksum, max(last_change) AS updated_at,
          coalesce(min(value) FILTER (WHERE prop = 'fileName'), min(value) FILTER (WHERE prop = 'title'), min(value) FILTER (WHERE prop = 'name'), {_label_sql()}) AS name,
          arg_min({_NORMAL}, value) FILTER (WHERE prop = 'mimeType' AND {_NORMAL} NOT IN ('', 'application/octet-stream')) AS said, coalesce(TRY_CAST(min(value) FILTER (WHERE prop = 'fileSize') AS BIGINT), 0) AS size
          FROM s JOIN v ON s.entity_id = v.entity_id WHERE s.schema IN ('Document', 'Pages', 'PlainText', 'HyperText', 'Table', 'Image', 'Email') GROUP BY 1),
    h AS (SELECT DISTINCT v.entity_id, w.path FROM v JOIN walk w ON v.value = w.id WHERE v.prop = 'parent')"""


@query(f"""WITH RECURSIVE {_DOCS} SELECT d.id, checksum, name, coalesce(said, {_ENDINGS}[regexp_extract(lower(name), '(\\.[a-z0-9]+)$', 1)], 'application/octet-stream') AS mimetype, h.path, size, updated_at, 'https://data.example.org/quay_registry/' || checksum AS public_url
    FROM d LEFT JOIN h ON d.id = h.entity_id WHERE checksum IS NOT NULL""")
def documents_csv(t):
    paths = hierarchy.resolve(hierarchy.newest_nodes(t.folders)).where("depth >= 0").select("id", hierarchy.path_text().alias("path"))
    return docs.listing(asm.assemble(t.live, t.registry), paths, t.registry.descendants("Document"), "quay_registry", "https://data.example.org/${dataset}")


@query(f"""WITH {MERGED}, {_CHANGED}, doc AS (SELECT DISTINCT entity_id FROM merged WHERE schema IN ('Document', 'Pages', 'PlainText', 'HyperText', 'Table', 'Image', 'Email'))
    SELECT CASE WHEN c.entity_id IN (SELECT entity_id FROM live) THEN 'ADD' ELSE 'DEL' END AS op, c.entity_id AS id FROM changed c JOIN doc ON c.entity_id = doc.entity_id""")
def documents_diff(t):
    wanted = t.kept.where(F.col("schema").isin([s for s in t.registry.descendants("Document") if s != "Folder"]))
    return feeds.diff(wanted, SINCE, t.registry).select("op", "id")


_MIMES = ", ".join(f"'{k}': '{v}'" for k, v in rules.MIME_SCHEMATA.items())
_CHAINS = """named AS (SELECT *, list_filter(string_split(replace(coalesce(key, ''), '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS names FROM files),
    chained AS (SELECT *, list_transform(range(1, len(names)), lambda i: list_reduce(list_prepend('', names[:i]), lambda a, n: 'folder-' || sha256(a || n))) AS chain,
                nullif(lower(trim(regexp_replace(mimetype, ';.*$', ''))), '') AS mime FROM named)"""
_FILE_PROPS = ("contentHash", "fileName", "fileSize", "mimeType", "parent", "title", "author")


@query(f"""WITH {_CHAINS} SELECT 'file-' || sha256(key || checksum) AS id, coalesce(MAP {{{_MIMES}}}[mime], 'Document') AS schema, origin, array_to_string(chain, ' ') AS chain,
    checksum AS "contentHash", coalesce(name, names[-1]) AS "fileName", size::VARCHAR AS "fileSize", mime AS "mimeType", chain[-1] AS parent, extra ->> '$.title' AS title, extra ->> '$.author' AS author FROM chained""")
def file_entities(t):
    """Whole payloads of all files, however their keys are spelt, with the ids of all folders on the way, outermost first."""
    chain = F.array_join(ids.folder_ids(ids.folder_names(F.col("key"))), " ").alias("chain")
    return docs.file_entities(t.files, chain).select("id", "schema", "origin", "chain", *[F.col("properties")[p][0].alias(p) for p in _FILE_PROPS])


@query(f"""WITH {_CHAINS} SELECT DISTINCT chain[i] AS id, 'Folder' AS schema, names[i] AS name, CASE WHEN i > 1 THEN chain[i - 1] END AS parent
    FROM (SELECT chain, names, unnest(range(1, len(names))) AS i FROM chained)""")
def folder_entities(t):
    """The folders on the way to all files, each with its parent."""
    return docs.folder_entities(t.files).select("id", "schema", F.col("properties")["fileName"][0].alias("name"), F.col("properties")["parent"][0].alias("parent"))


# ---- SQL passthrough: joins, windows, grouping sets, set operations, functions


def passthrough(t, text: str, *names: str) -> DataFrame:
    """SQL over the views; names are unique per call, so that queries do not disturb each other."""
    for name in names:
        view = f"{name}_{uuid.uuid4().hex[:8]}"
        {"statement": lambda: live_view(t.raw), "statement_raw": lambda: t.raw}.get(name, lambda: getattr(t, name))().createOrReplaceTempView(view)
        text = text.replace("{" + name + "}", view)
    return t.spark.sql(text)


_WINDOW = "SELECT entity_id, id, last_seen, rank() OVER (PARTITION BY entity_id ORDER BY last_seen DESC, id) AS r, lag(id) OVER (PARTITION BY entity_id ORDER BY last_seen, id, origin, fragment, row_no) AS before FROM {statements}"


@query(_WINDOW.replace("{statements}", "statements"))
def sql_window(t):
    return passthrough(t, _WINDOW, "statements")


_ROLLUP = "SELECT bucket, schema, count(*) AS n, count(DISTINCT entity_id) AS entities FROM {statement_raw} GROUP BY ROLLUP (bucket, schema)"


@query(_ROLLUP.replace("{statement_raw}", "statements"))
def sql_rollup(t):
    return passthrough(t, _ROLLUP, "statement_raw")


_SETS = "SELECT bucket, origin, schema, count(*) AS n FROM {statement_raw} GROUP BY GROUPING SETS ((bucket, origin), (schema), ())"


@query(_SETS.replace("{statement_raw}", "statements"))
def sql_grouping_sets(t):
    return passthrough(t, _SETS, "statement_raw")


_CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"


@query(_CUBE.replace("{lineitem}", "lineitem"))
def sql_cube(t):
    return passthrough(t, _CUBE, "lineitem")


_SETOPS = "(SELECT entity_id FROM {statement_raw} WHERE prop = 'name' INTERSECT SELECT entity_id FROM {statement_raw} WHERE prop = 'alias') EXCEPT SELECT entity_id FROM {statement_raw} WHERE prop = 'country'"


@query(_SETOPS.replace("{statement_raw}", "statements"))
def sql_set_ops(t):
    return passthrough(t, _SETOPS, "statement_raw")


@query("SELECT row_no, extra ->> '$.title' AS title, extra ->> '$.author' AS author FROM files")
def sql_json(t):
    return passthrough(t, "SELECT row_no, get_json_object(extra, '$.title') AS title, get_json_object(extra, '$.author') AS author FROM {files}", "files")


@query("SELECT id, origin, fragment, row_no, year(first_seen) AS y, month(first_seen) AS m, date_trunc('month', first_seen)::TIMESTAMP AS month, datediff('day', first_seen, last_seen) AS days FROM statements")
def sql_dates(t):
    return passthrough(
        t,
        "SELECT id, origin, fragment, row_no, CAST(year(first_seen) AS BIGINT) AS y, CAST(month(first_seen) AS BIGINT) AS m, CAST(date_trunc('month', first_seen) AS TIMESTAMP_NTZ) AS month, CAST(datediff(last_seen, first_seen) AS BIGINT) AS days FROM {statements}",
        "statements",
    )


_JOINS = """SELECT n.n_name, r.r_name, count(o.o_orderkey) AS orders, count(DISTINCT c.c_custkey) AS customers FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey
    LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY n.n_name, r.r_name"""


@query(_JOINS.replace("{", "").replace("}", ""))
def sql_joins(t):
    return passthrough(t, _JOINS, "region", "nation", "customer", "orders")


@query("""SELECT e.event_id, max(p.event_id) AS before FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pid FROM events) e LEFT JOIN events p ON p.event_id = e.pid GROUP BY 1""")
def asof_previous(t):
    """As-of match of each event with the same user's latest earlier one, as a window over one shuffle instead of an inequality join."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_id").over(line).alias("before"))


@query("""WITH s AS (SELECT entity_id, last_seen, max(row_no) AS row_no FROM statements WHERE last_seen IS NOT NULL GROUP BY ALL)
    SELECT message_no, s.last_seen AS seen, s.row_no FROM journal j ASOF LEFT JOIN s ON j.entity_id = s.entity_id AND j.received_at >= s.last_seen""")
def asof_statements(t):
    """With each journal message the entity's latest statement up to its arrival."""
    observed = t.statements.select("entity_id", "last_seen", "row_no")
    joined = asof.asof_join(t.journal.select("message_no", "entity_id", "received_at"), observed, "entity_id", "received_at", "last_seen")
    return joined.select("message_no", F.col("matched.last_seen").alias("seen"), F.col("matched.row_no").alias("row_no"))


@query("SELECT count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_custkey) AS median FROM orders")
def sql_percentile(t):
    return passthrough(t, "SELECT count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_custkey) AS median FROM {orders}", "orders").select("n", F.col("median").cast("long").alias("median"))


@query("SELECT DISTINCT entity_id, lower(format('{:x}', cast('0x' || substr(sha1(entity_id), 1, 8) AS BIGINT) % 16)) AS shard FROM statements WHERE deleted_at IS NULL")
def sql_functions(t):
    ids.register_sql_functions(t.spark)
    return passthrough(t, "SELECT DISTINCT entity_id, entity_shard(entity_id, 16) AS shard FROM {statement}", "statement")


# ---- the stored table and its exports


def stored(t, parts: int = 1) -> StatementStore:
    """The log as a table of the store, appended in ``parts``."""
    store = StatementStore(t.spark, Scratch(t.spark, "stored").path("statements"), 16)
    for n in range(parts):
        store.append(conform(t.statements.where(F.col("batch_no") % parts == n) if parts > 1 else t.statements))
    return store


def naive(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


@query(f"WITH {MERGED} SELECT {_CORE} FROM live")
def store_merged(t):
    """Two appends, a merge, a vacuum; then what the live view reads from the files."""
    store = stored(t, 2)
    store.merge()
    store.vacuum()
    return naive(store.live().select(*CORE))


@query(f"SELECT {_CORE} FROM (SELECT * REPLACE (coalesce(fragment, '') AS fragment) FROM statements)")
def store_compacted(t):
    """Three appends whose files are joined by block copies: every row exactly as often as before."""
    store = stored(t, 3)
    store.compact()
    return naive(store.raw().select(*CORE))


@query(rows_of("bool_or(schema = 'Person') AND bool_or(prop = 'name' AND value >= 'M')"))
def store_query(t):
    """A query over the stored, merged table, which reads only the buckets of its schema."""
    store = stored(t)
    store.merge()
    return t.compiler.statements(store.live(), Query(M(schema="Person"), P(name__gte="M"))).select("id", "entity_id", "prop", "value", "origin", "fragment")


@query(f"""WITH {MERGED} SELECT id, entity_id, prop, coalesce(value, '') AS value, coalesce(original_value, '') AS original_value, coalesce(lang, '') AS lang, origin,
    strftime(first_seen, '%Y-%m-%dT%H:%M:%S') AS first_seen, fragment FROM live""")
def csv_roundtrip(t):
    """Live statements exported as CSV parts in zstd and read back."""
    path = Scratch(t.spark, "export").path("statements.csv")
    fmt.write_csv(t.live, path, "zst")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("value", "original_value", "lang", "fragment")]
    return fmt.read_csv_text(t.spark, path).select("id", "entity_id", "prop", *texts[:3], "origin", "first_seen", texts[3])


@query(f"""WITH {_ENTITY}, p AS (SELECT entity_id, string_agg(prop || '=' || value, '|' ORDER BY prop, value) AS properties FROM v GROUP BY 1)
    SELECT s.entity_id AS id, s.schema, coalesce(properties, '') AS properties FROM s LEFT JOIN p ON s.entity_id = p.entity_id WHERE s.schema IS NOT NULL""")
def entities_roundtrip(t):
    """Entities exported as JSON lines in gzip and read back."""
    path = Scratch(t.spark, "export").path("entities.json")
    fmt.write_entities(asm.assemble(t.live, t.registry), path, "gz")
    entries = F.array_sort(F.map_entries("properties"))
    flat = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v))))
    return fmt.read_entities(t.spark, path).select("id", "schema", F.array_join(flat, "|").alias("properties"))


# ---- journal and streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t):
    stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return jr.windowed_counts(stamped, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(t):
    stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return jr.session_counts(stamped, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT lower(format('{:x}', cast('0x' || substr(sha1(entity_id), 1, 8) AS BIGINT) % 16)) AS shard, lower(trim(id)) AS id, entity_id, origin, coalesce(fragment, '') AS fragment, value, last_seen FROM journal""")
def journal_drain(t):
    """Land the journal, drain it through the streaming sink, read the table back."""
    root = Scratch(t.spark, "drain").path("dataset")
    store = StatementStore(t.spark, f"{root}/statements", 16)
    buffered = jr.Journal(t.spark, f"{root}/journal", store)
    buffered.add(conform(t.journal).withColumn("id", F.lower(F.trim("id"))))
    buffered.flush()
    return store.raw().select("shard", "id", "entity_id", "origin", "fragment", "value", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
