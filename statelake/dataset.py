"""A dataset: its settings, table, journal and archive, and the operations on them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from datetime import timedelta

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.functions.ids import entity_shard
from statelake.functions.values import validate_dataset_name
from statelake.operators import documents as docs
from statelake.operators.assemble import assemble, explode, override, tombstones
from statelake.operators.feeds import changed_ids, diff, envelopes
from statelake.operators.stats import summary
from statelake.plans.query import Compiler, Query
from statelake.registry import Registry
from statelake.sources.archive import Archive
from statelake.sources.compressed import SUFFIX, stream_out, write_lines
from statelake.sources.files import csv_line, csv_projection, read_csv_text, read_entities, statements_from_csv, write_csv, write_entities
from statelake.sources.paths import Folder
from statelake.sources.store import StatementStore
from statelake.sources.tags import Jobs, Tags, Versions, utc_now
from statelake.streaming.journal import Journal

ARTIFACTS = {"statements": "statements.csv", "entities": "entities.json", "documents": "documents.csv"}
EXPORTS = ("statements", "entities", "documents", "statistics", "index")


@dataclass
class Config:
    name: str
    title: str | None = None
    shards: int = 1
    compression: str | None = None  # of exports: gz, zst or none
    public_url_prefix: str | None = None
    updated_at: str | None = None


class Dataset:
    def __init__(self, spark: SparkSession, root: str, config: Config, registry: Registry | None = None):
        validate_dataset_name(config.name)
        if config.compression not in SUFFIX:
            raise ValueError(f"unknown compression {config.compression!r}")
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.registry = registry or Registry()
        self.folder = Folder(spark, self.root)
        self.store = StatementStore(spark, f"{self.root}/statements", config.shards)
        self.journal = Journal(spark, f"{self.root}/journal", self.store)
        self.archive = Archive(spark, self.root, config.name)
        self.tags = Tags(Folder(spark, f"{self.root}/tags"))
        self.jobs = Jobs(Folder(spark, f"{self.root}/jobs"))
        self.versions = Versions(self.folder)
        self.compiler = Compiler(self.registry, config.shards)

    # ---- writing

    def write_entities(self, entities: DataFrame, origin: str | None = None, bulk: bool = False, now: str | None = None) -> None:
        """Explode payloads into the journal, or straight into the table."""
        rows = explode(entities, self.registry, self.config.name, self.config.shards, now or utc_now().strftime("%Y-%m-%d %H:%M:%S"), origin)
        self.store.append(rows) if bulk else self.journal.add(rows)

    def write_statements(self, rows: DataFrame, bulk: bool = False) -> None:
        """Statement rows as they are, into the journal, or straight into the table; shards are derived anew."""
        sharded = rows.withColumn("shard", entity_shard(F.col("entity_id"), self.config.shards))
        self.store.append(sharded) if bulk else self.journal.add(sharded)

    def import_entities(self, path: str, origin: str | None = None, bulk: bool = True) -> None:
        self.write_entities(read_entities(self.spark, path), origin, bulk)

    def import_statements(self, path: str, origin: str | None = None, override_origin: str | None = None) -> int:
        now = utc_now().strftime("%Y-%m-%d %H:%M:%S")
        return self.store.append(statements_from_csv(read_csv_text(self.spark, path), self.registry, self.config.name, self.config.shards, now, origin, override_origin))

    def delete_entity(self, entity_id: str, at: str | None = None) -> int:
        """Tombstones for all live rows of an entity, buffered ones included; returns their number."""
        mine = F.col("entity_id") == entity_id
        rows = override(self.store.raw().where(mine), self.journal.rows().where(mine)).where("deleted_at is null")
        return self._bury(rows, at)

    def delete_statement(self, statement_id: str, at: str | None = None) -> int:
        mine = F.col("id") == statement_id
        rows = override(self.store.raw().where(mine), self.journal.rows().where(mine)).where("deleted_at is null")
        return self._bury(rows, at)

    def _bury(self, rows: DataFrame, at: str | None) -> int:
        count = rows.count()
        if count:
            self.journal.add(tombstones(rows, at or utc_now().strftime("%Y-%m-%d %H:%M:%S")))
        return count

    def flush(self) -> int:
        return self.journal.flush()

    def unlock(self) -> bool:
        """Free the locks that dead processes have left on the table and the journal."""
        table, journal = self.store.unlock(), self.journal.unlock()
        return table or journal

    # ---- reading

    def query_statements(self, query: Query | None = None, flush: bool = False) -> DataFrame:
        if flush:
            self.flush()
        return self.compiler.statements(self.store.live(), query or Query())

    def query(self, query: Query | None = None, flush: bool = False) -> DataFrame:
        """Whole entities, in order if the query sorts."""
        query = query or Query()
        return self.compiler.in_order(assemble(self.query_statements(query, flush), self.registry), query)

    def get(self, entity_id: str) -> DataFrame:
        from statelake.plans.query import M

        return self.query(Query(M(entity_id=entity_id)))

    def count(self, query: Query | None = None) -> int:
        return self.compiler.count(self.store.live(), query or Query()).first()[0]

    def sql(self, text: str) -> DataFrame:
        """Any SQL over the views ``statement`` and ``statement_raw``."""
        self.store.register_views()
        return self.spark.sql(text)

    # ---- operations

    def optimize(self, force: bool = False, grace: timedelta = timedelta(days=7)) -> dict:
        """Merge, compact, vacuum; nothing is done for a table without dirty partitions unless forced."""

        def work(job):
            if not force and not self.store.needs_merge():
                return {"merged": 0, "compacted": 0, "vacuumed": 0}
            return {"merged": len(self.store.merge(force, grace)), "compacted": self.store.compact(), "vacuumed": self.store.vacuum()}

        return self.jobs.run("optimize", work)[1]

    def _prepare(self) -> None:
        if not self.journal.is_empty():
            self.flush()
        if self.store.needs_merge():
            self.store.merge()

    def export(self, kind: str, force: bool = False) -> bool:
        """Produce one export if it is not newer than the table; returns whether it was made."""
        if kind not in EXPORTS:
            raise ValueError(f"unknown export {kind!r}")
        self._prepare()
        if not force and Tags(self.folder).is_latest(f"tags/exports/{kind}", ["statements/tags/optimized"]):
            return False
        started = utc_now()
        self.jobs.run(f"export-{kind}", lambda job: getattr(self, f"_export_{kind}")())
        self.tags.touch(f"exports/{kind}", started)
        return True

    def make(self, force: bool = False) -> dict[str, bool]:
        """Flush and all exports, in order."""
        self.flush()
        return {kind: self.export(kind, force) for kind in EXPORTS}

    def _out(self, name: str) -> str:
        return f"{self.root}/exports/{name}"

    def _export_statements(self) -> None:
        write_csv(self.store.live(), self._out(ARTIFACTS["statements"]), self.config.compression)

    def _export_entities(self) -> None:
        write_entities(self.query(), self._out(ARTIFACTS["entities"]), self.config.compression)
        self.export_diff("entities")

    def stream_export(self, kind: str, out) -> int:
        """Write an export to an open binary file as one plain text, whatever its compression; returns the bytes."""
        if kind not in ARTIFACTS:
            raise ValueError(f"{kind!r} is not exported in parts")
        path = self._out(ARTIFACTS[kind])
        if not Folder(self.spark, path).exists(""):
            raise FileNotFoundError(f"{kind} have not been exported")
        return stream_out(self.spark, path, out, head=ARTIFACTS[kind].endswith(".csv"))

    def exported_entities(self) -> DataFrame:
        """The entities of the last export, without a query over the table."""
        return read_entities(self.spark, self._out(ARTIFACTS["entities"]))

    def exported_statements(self) -> DataFrame:
        """The statements of the last export, as text columns."""
        return read_csv_text(self.spark, self._out(ARTIFACTS["statements"]))

    def _documents(self) -> DataFrame:
        entities = self.query(Query())
        paths = docs.folder_paths(entities.where("schema = 'Folder'"))
        return docs.listing(entities, paths, self.registry.descendants("Document"), self.config.name, self.config.public_url_prefix)

    def _export_documents(self) -> None:
        listing = self._documents()
        if not listing.isEmpty():
            rows = listing.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss")).orderBy("path", "name", "id")
            write_lines(rows.select(csv_line(rows.columns)), self._out(ARTIFACTS["documents"]), self.config.compression, ",".join(rows.columns))
            self.export_diff("documents")

    def _export_statistics(self) -> None:
        self.versions.make("statistics.json", json.dumps(summary(self.store.live(), self.registry), sort_keys=True))

    def _export_index(self) -> None:
        self.versions.make("index.json", json.dumps(asdict(self.config), sort_keys=True))

    def export_diff(self, kind: str = "entities") -> str | None:
        """Write what changed since the last diff; returns its folder, or ``None`` if nothing did."""
        current = self.store.version()
        if current is None:
            return None
        if self.store.needs_merge():
            raise RuntimeError("the table has to be merged before a diff")
        state = f"diffs/{kind}.state"
        since, last = (self.folder.read(state).split("|") + [""])[:2] if self.folder.exists(state) else (None, None)
        if last and int(last) >= current:
            return None
        raw = self.store.raw()
        now = utc_now().strftime("%Y-%m-%d %H:%M:%S.%f")
        done = None
        if since is None or not changed_ids(raw, since).isEmpty():
            feed = diff(raw, since, self.registry)
            if kind == "documents":
                ids = feed.where("op = 'DEL'").select("op", "id").unionByName(feed.where(F.col("entity.schema").isin([s for s in self.registry.descendants("Document") if s != "Folder"])).select("op", "id"))
                lines = ids.select(F.to_json(F.struct("op", "id")).alias("value"))
            else:
                lines = envelopes(feed)
            done = self._out(f"diff/{kind}/{now.replace(' ', 'T').replace(':', '')}")
            write_lines(lines, done)
        self.folder.write(state, f"{now}|{current}")
        return done

    def csv(self) -> DataFrame:
        return csv_projection(self.store.live())


class Catalog:
    """All datasets below one root: folders with a ``config.yml``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def names(self) -> list[str]:
        return [n for n in self.folder.names() if self.folder.exists(f"{n}/config.yml")]

    def exists(self, name: str) -> bool:
        return self.folder.exists(f"{validate_dataset_name(name)}/config.yml")

    def config(self, name: str) -> Config:
        """Read anew each time; a missing config falls back to the exported index."""
        validate_dataset_name(name)
        for path in (f"{name}/config.yml", f"{name}/index.json"):
            if self.folder.exists(path):
                known = {f.name for f in fields(Config)}
                return Config(**{k: v for k, v in (yaml.safe_load(self.folder.read(path)) or {}).items() if k in known})
        raise KeyError(name)

    def update(self, name: str, **changes) -> Config:
        """Merge changes into the config and keep a snapshot. The number of shards is fixed at creation."""
        validate_dataset_name(name)
        old = asdict(self.config(name)) if self.exists(name) else {}
        if old and changes.get("shards", old["shards"]) != old["shards"]:
            raise ValueError("the number of shards of a dataset cannot change")
        merged = {**old, **{k: v for k, v in changes.items() if v is not None}, "name": name, "updated_at": utc_now().isoformat()}
        Versions(Folder(self.spark, f"{self.root}/{name}")).make("config.yml", yaml.safe_dump(merged, sort_keys=True))
        return self.config(name)

    def dataset(self, name: str, registry: Registry | None = None, **defaults) -> Dataset:
        """Get or create."""
        config = self.config(name) if self.exists(name) else self.update(name, **defaults)
        return Dataset(self.spark, f"{self.root}/{name}", config, registry)
