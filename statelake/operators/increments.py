"""Runs that take up only what is new or changed since the last success.

Inputs are files below a folder, one subfolder per batch. A manifest lists the
files that successful runs have taken up, each with its size and checksum. A run

1. lists the inputs (``listing``: path, size and checksum of the content, made by
   the executors),
2. anti-joins the listing against the manifest: a file that is unknown, or
   whose size or checksum differs, is pending; no other file is opened,
3. reduces the pending files to one state per record and compares it with the
   states that earlier runs have left in the *record store* (for the entities at
   hand only): a record is new if no earlier run saw it in an earlier batch,
4. writes its manifest entries, its record states and its result below folders
   named by its run identifier, replacing whatever a failed attempt left there,
5. commits by publishing one small file, the next manifest version, which names
   those folders; it appears whole, and for one run only (:meth:`Folder.create`).

A run that dies before step 5 leaves manifest and store as they were and is
repeated in full; one that dies after it is not repeated.

Skew: rows are reduced per record, with map-side combine, before anything is
grouped by entity; an entity with a third of all rows is spread by its records.

Edge cases: statements with a null batch number belong to no input and are
ignored; null ``id``, ``origin``, ``fragment`` compare equal to null; a record
is deleted if among its rows with the greatest ``last_seen`` one is a tombstone;
null ``last_seen`` is oldest; empty tables give no changes. A statement ``id`` is a
hash over its entity, so the entity is a function of the record. Of an input that
was replaced by another content, rows that have vanished stay in the store.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.session import Scratch
from statelake.sources.paths import Folder

INPUT = ["id", "origin", "fragment", "entity_id", "last_seen", "deleted_at"]
LISTING = "path string, batch_no bigint, size bigint, checksum bigint"
RECORD = ["id", "origin", "fragment", "entity_id"]
STATE = "id string, origin string, fragment string, entity_id string, first_batch bigint, dead_batch bigint, state bigint"
ROWS_PER_FILE = 500_000
SNAPSHOT = 16


def land(statements: DataFrame, folder: str) -> None:
    """Write rows as input files, one subfolder per batch. Stands in for a feed that delivers its batches as files."""
    rows = statements.where("batch_no is not null").select("batch_no", *INPUT).hint("rebalance", F.col("batch_no"))
    rows.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").partitionBy("batch_no").parquet(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, batch_no, size, checksum`` of each input file; paths are relative to ``folder``. Contents are hashed where they lie and not decoded."""
    if not Folder(spark, folder).exists(""):
        return spark.createDataFrame([], LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    path = F.regexp_extract("path", "(batch_no=[^/]*/.*)$", 1)
    return found.select(path.alias("path"), F.regexp_extract(path, "=(-?[0-9]+)/", 1).cast("bigint").alias("batch_no"), F.col("length").alias("size"), F.xxhash64("content").alias("checksum"))


def read_files(listed: DataFrame, folder: str) -> DataFrame:
    """The rows of listed files with their batch number. The driver learns the paths, as for every scan, and no other file is opened."""
    spark = listed.sparkSession
    paths = [f"{folder}/{r[0]}" for r in listed.select("path").collect()]
    schema = "id string, origin string, fragment string, entity_id string, last_seen timestamp_ntz, deleted_at timestamp_ntz, batch_no bigint"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths)


def record_states(rows: DataFrame) -> DataFrame:
    """One row per record (``STATE``): its first batch, its first batch with a tombstone, and a number that orders by ``last_seen`` and is odd for a tombstone."""
    us = F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(-(2**61)))
    dead = F.col("deleted_at").isNotNull()
    # the newest row wins and, of equally new ones, a tombstone
    keyed = rows.select(*RECORD, "batch_no", F.when(dead, F.col("batch_no")).alias("dead"), (us * 2 + dead.cast("long")).alias("s"))
    return keyed.groupBy(*RECORD).agg(F.min("batch_no").alias("first_batch"), F.min("dead").alias("dead_batch"), F.max("s").alias("state"))


def covered_batches(runs: DataFrame, kind: str = "entities") -> DataFrame:
    """Batch numbers within the bounds of a successful run. Bounds that are null or reversed cover nothing."""
    ok = runs.where((F.col("kind") == kind) & (F.col("status") == "ok") & (F.col("from_batch") <= F.col("to_batch")))
    return ok.select(F.explode(F.sequence("from_batch", "to_batch")).alias("batch_no")).distinct()


class Manifest:
    """What successful runs have taken up: versions of the list of input files, and the record store, below ``root``.

    A version names the folders that hold its entries and states; every ``SNAPSHOT`` versions they are folded into one each.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max([int(n[1:].split(".")[0]) for n in self.folder.names("manifest") if n.startswith("v")], default=0)

    def _named(self, what: str) -> list[str]:
        version = self.version()
        return json.loads(self.folder.read(f"manifest/v{version:08d}.json"))[what] if version else []

    def _table(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in self._named(what)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The files taken up, in the content they had."""
        return self._table("files", LISTING)

    def records(self) -> DataFrame:
        """States that runs have left, a record once for each run that met it."""
        return self._table("records", STATE)

    def pending(self, inputs: DataFrame) -> DataFrame:
        return inputs.join(self.entries(), ["path", "size", "checksum"], "left_anti").select("path", "batch_no", "size", "checksum")

    def output_path(self, run_id: str) -> str:
        return f"{self.root}/output/run={run_id}"

    def prepare(self, run_id: str, what: str, rows: DataFrame) -> DataFrame:
        """Write ``files`` or ``records`` that a commit of ``run_id`` will name; returns a reader of what was written."""
        path = f"{self.root}/{what}/run={run_id}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, run_id: str, base: int) -> int:
        """Publish the version after ``base`` with what was prepared; fails if another run has."""
        version = base + 1
        if self.version() != base:
            raise RuntimeError(f"manifest version {version} exists: another run has committed")
        named = {what: [*self._named(what), f"{what}/run={run_id}"] for what in ("files", "records")}
        if version % SNAPSHOT == 0:
            named = self._fold(named, version, run_id)
        if not self.folder.create(f"manifest/v{version:08d}.json", json.dumps({"run_id": run_id, **named})):
            raise RuntimeError(f"manifest version {version} exists: another run has committed")
        return version

    def _fold(self, named: dict[str, list[str]], version: int, run_id: str) -> dict[str, list[str]]:
        files, records = [self.spark.read.schema(s).parquet(*[f"{self.root}/{p}" for p in named[w]]) for w, s in (("files", LISTING), ("records", STATE))]
        out = {"files": f"files/upto={version}-{run_id}", "records": f"records/upto={version}-{run_id}"}
        files.distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{out['files']}")
        merged_states(records).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{out['records']}")
        return {what: [path] for what, path in out.items()}


def merged_states(*states: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*RECORD).agg(F.min("first_batch").alias("first_batch"), F.min("dead_batch").alias("dead_batch"), F.max("state").alias("state"))


def changed_entities(states: DataFrame, known: DataFrame) -> DataFrame:
    """``entity_id, op`` of entities with a record that ``states`` sees first, or first deleted, before any of ``known``.

    ``op`` is ``DEL`` if no record of the entity is live in either. Two aggregates: by record (unique enough that skew cannot arise
    from an entity), then by entity with map-side combine.
    """
    touched = states.where("entity_id is not null").select("entity_id").distinct()
    earlier = known.join(touched, "entity_id", "left_semi")
    sides = states.select(*RECORD, "first_batch", "dead_batch", "state", F.lit(True).alias("now")).unionByName(earlier.select(*RECORD, "first_batch", "dead_batch", "state", F.lit(False).alias("now")))
    at = lambda name, now: F.min(F.when(F.col("now") == F.lit(now), F.col(name)))
    records = sides.groupBy(*RECORD).agg(at("first_batch", True).alias("f1"), at("first_batch", False).alias("f0"), at("dead_batch", True).alias("d1"), at("dead_batch", False).alias("d0"), F.max("state").alias("state"))
    earlier_now = lambda new, old: F.col(new).isNotNull() & (F.col(old).isNull() | (F.col(new) < F.col(old)))
    entities = records.groupBy("entity_id").agg(F.max(earlier_now("f1", "f0") | earlier_now("d1", "d0")).alias("changed"), F.max(F.expr("pmod(state, 2) = 0")).alias("live"))
    return entities.where("changed and entity_id is not null").select("entity_id", F.when(F.col("live"), "ADD").otherwise("DEL").alias("op"))


def run_increment(spark: SparkSession, inputs: str, manifest: Manifest, run_id: str, listed: DataFrame | None = None) -> DataFrame:
    """One run over the files below ``inputs``: list, anti-join, compare, write under the run's identifier, commit. Returns what was written."""
    base = manifest.version()
    pending = manifest.prepare(run_id, "files", manifest.pending(listing(spark, inputs) if listed is None else listed).coalesce(1))
    states = manifest.prepare(run_id, "records", record_states(read_files(pending, inputs)))
    out = manifest.output_path(run_id)
    changed_entities(states, manifest.records()).write.mode("overwrite").parquet(out)
    manifest.commit(run_id, base)
    return spark.read.schema("entity_id string, op string").parquet(out)


def increment_after_runs(statements: DataFrame, runs: DataFrame, run_id: str = "next") -> DataFrame:
    """The increment due after the ``runs`` on record: what they covered forms the manifest's first version, all else is pending."""
    spark = statements.sparkSession
    scratch = Scratch(spark, "increment")
    inputs, manifest = scratch.path("inputs"), Manifest(spark, scratch.path("store"))
    land(statements, inputs)
    listed = scratch.stage(listing(spark, inputs).coalesce(1), "listing")
    covered = listed.join(covered_batches(runs), "batch_no", "left_semi").select(listed.columns)
    covered = manifest.prepare("history", "files", covered.coalesce(1))
    manifest.prepare("history", "records", record_states(read_files(covered, inputs)))
    manifest.commit("history", 0)
    return run_increment(spark, inputs, manifest, run_id, listed)
