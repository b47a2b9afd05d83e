"""The versioned statement table: parquet files named by a log of commits.

A commit is one small JSON file that lists the files added and removed; every
``SNAPSHOT`` commits a snapshot lists all live files. A commit appears whole and
exclusively (:meth:`Folder.create`): of two writers of one version one wins, the
other tries again on top of it. Readers pick a version and read exactly its
files, with partition columns from their folders, so filters on them prune files.

Each file entry states what wrote it. A partition with a file of an append, or
with files of more than one merge, is *dirty*: this follows from the log alone,
so no crash can lose it.

Fence. An append first registers a marker and then looks for the maintenance
lock; if it is held, the marker is withdrawn and the append waits. Maintenance
(merge, compaction, vacuum) first takes the lock and then waits until no marker
is left. So no append is under way while maintenance reads its base, commits, or
deletes files that no commit names. Appends do not exclude each other.

The log names files, not rows: merge and compaction keep files at hundreds of
megabytes, so that a table of 100 TB has some 10^5 entries.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.functions.values import validate_origin
from statelake.operators import smallfiles
from statelake.operators.merge import merge, sorted_for_files
from statelake.schema import NAMES, NULLABLE, PARTITIONS, conform, enforce_required, live_view
from statelake.session import shuffle_partitions
from statelake.sources.paths import Folder
from statelake.sources.tags import Tags

SMALL_FILE = 32 << 20
TARGET_ROWS = 5_000_000
SNAPSHOT = 16
APPEND, MERGE, COMPACT = "append", "merge", "compact"

Key = tuple[str, str, str]


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class StatementStore:
    def __init__(self, spark: SparkSession, root: str, shards: int = 1):
        self.spark, self.root, self.shards = spark, root.rstrip("/"), shards
        self.folder = Folder(spark, self.root)
        self.tags = Tags(Folder(spark, f"{self.root}/tags"))
        self._frames: dict[str, DataFrame] = {}

    # ---- log

    def version(self) -> int | None:
        """The newest version; ``None`` if there is no table."""
        names = [n for n in self.folder.names("log") if n.startswith("v")]
        return max((int(n[1:].split(".")[0]) for n in names), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def files(self, version: int | None = None) -> list[dict]:
        """Live files of a version: path, partition, size and what wrote them. The last snapshot, and the commits since."""
        version = self.version() if version is None else version
        if version is None:
            return []
        snapshot = max((int(n[1:].split(".")[0]) for n in self.folder.names("log") if n.startswith("s") and int(n[1:].split(".")[0]) <= version), default=None)
        live = {} if snapshot is None else {f["path"]: f for f in json.loads(self.folder.read(f"log/s{snapshot:012d}.json"))}
        for number in range(0 if snapshot is None else snapshot + 1, version + 1):
            entry = json.loads(self.folder.read(f"log/v{number:012d}.json"))
            for path in entry["remove"]:
                del live[path]
            live |= {f["path"]: f for f in entry["add"]}
        return list(live.values())

    def _commit(self, base: int | None, add: list[dict], remove: list[dict], operation: str) -> int:
        version = 0 if base is None else base + 1
        body = json.dumps({"operation": operation, "at": _now().isoformat(), "add": add, "remove": [f["path"] for f in remove]})
        if not self.folder.create(f"log/v{version:012d}.json", body):
            raise Conflict(f"version {version} exists")
        if version and version % SNAPSHOT == 0:
            self.folder.create(f"log/s{version:012d}.json", json.dumps(self.files(version)))
        return version

    def ensure(self) -> int:
        """An empty version 0 if there is no table."""
        version = self.version()
        if version is None:
            try:
                return self._commit(None, [], [], "create")
            except Conflict:
                return self.version() or 0
        return version

    # ---- reading

    def raw(self, version: int | None = None) -> DataFrame:
        """Every physical row of a version. Versions do not change, so the listing of the last one read is kept."""
        version = self.version() if version is None else version
        if version is None:
            return self._read([])
        commit = self.folder.read(f"log/v{version:012d}.json")  # a table that was destroyed counts from 0 again
        if commit not in self._frames:
            self._frames = {commit: self._read(self.files(version))}
        return self._frames[commit]

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], NULLABLE)
        paths = [f"{self.root}/data/{f['path']}" for f in files]
        return self.spark.read.schema(NULLABLE).option("basePath", f"{self.root}/data").parquet(*paths).select(*NAMES)

    def live(self, version: int | None = None) -> DataFrame:
        return live_view(self.raw(version))

    def register_views(self) -> None:
        self.raw().createOrReplaceTempView("statement_raw")
        self.live().createOrReplaceTempView("statement")

    def partitions(self) -> list[Key]:
        """Partitions in order, from the log, without a scan."""
        return sorted({_key(f) for f in self.files()})

    def partition_bytes(self) -> dict[Key, int]:
        out: dict[Key, int] = {}
        for f in self.files():
            out[_key(f)] = out.get(_key(f), 0) + f["size"]
        return out

    def by_partition(self, version: int | None = None) -> Iterator[tuple[tuple[str, str], DataFrame]]:
        """``(shard, bucket)`` in order, each with its rows of one version. A job over all rows needs no such loop; streams that must stay small do."""
        groups: dict[tuple[str, str], list[dict]] = {}
        for f in self.files(version):
            groups.setdefault((f["shard"], f["bucket"]), []).append(f)
        for key in sorted(groups):
            yield key, self._read(groups[key])

    def select_partition(self, shard: str, bucket: str) -> DataFrame:
        return self.raw().where((F.col("shard") == shard) & (F.col("bucket") == bucket))

    # ---- writing

    def _write(self, rows: DataFrame, operation: str) -> list[dict]:
        """Write files into a folder of their own; they are not visible before a commit names them."""
        batch = f"batch={operation}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", TARGET_ROWS).partitionBy(*PARTITIONS).parquet(f"{self.root}/data/{batch}")
        return [_entry(f"{batch}/{path}", size, operation) for path, size in self.folder.walk(f"data/{batch}") if path.endswith(".parquet")]

    def append(self, rows: DataFrame, retries: int = 10) -> int:
        """Add rows as they are; returns the new version. Nothing is committed for an empty batch."""
        self.ensure()
        with self.appending():
            new = self._write(balanced(enforce_required(conform(rows))), APPEND)
            if not new:
                return self.version() or 0
            for key in {_key(f) for f in new}:
                validate_origin(key[2])
            for attempt in range(retries):
                try:
                    return self._commit(self.ensure(), new, [], APPEND)
                except Conflict:
                    time.sleep(0.05 * (attempt + 1))
            raise Conflict("append: too many concurrent commits")

    def dirty(self, files: list[dict] | None = None) -> list[Key]:
        """Partitions with rows that no merge has seen, or seen together with the others."""
        writers: dict[Key, set[str]] = {}
        for f in self.files() if files is None else files:
            writers.setdefault(_key(f), set()).add(f["by"])
        return sorted(k for k, by in writers.items() if APPEND in by or len(by) > 1)

    def needs_merge(self) -> bool:
        return bool(self.dirty())

    def merge(self, force: bool = False, grace: timedelta = timedelta(days=7), now: datetime | None = None) -> list[Key]:
        """Merge all dirty partitions in one job and one commit; returns them. ``force`` takes every partition."""
        if not self.exists():
            return []
        with self.lock():
            base, started = self.version(), _now()
            files = self.files(base)
            keys = sorted({_key(f) for f in files}) if force else self.dirty(files)
            if not keys:
                return []
            wanted = set(keys)
            old = [f for f in files if _key(f) in wanted]
            cutoff = ((now or _now()) - grace).strftime("%Y-%m-%d %H:%M:%S")
            new = self._write(sorted_for_files(balanced(merge(self._read(old), cutoff))), MERGE)
            run = uuid.uuid4().hex[:12]
            self._commit(base, [f | {"by": f"{MERGE}-{run}"} for f in new], old, MERGE)
        self.tags.touch("optimized", started)
        return keys

    def compact(self, small: int = SMALL_FILE, target: int = smallfiles.TARGET_BYTES, max_files: int = smallfiles.MAX_FILES) -> int:
        """Join the small files of each partition by copying their column blocks; rows stay as they are. Returns the number of files saved.

        A file that was joined of several writers' counts as an append, so that partitions stay as dirty as they were.
        """
        if not self.exists():
            return 0
        with self.lock():
            base = self.version()
            groups: dict[Key, list[dict]] = {}
            for f in self.files(base):
                if f["size"] < small:
                    groups.setdefault(_key(f), []).append(f)
            bins = [b for fs in groups.values() for b in _bins(fs, target, max_files) if len(b) > 1]
            if not bins:
                return 0
            batch = f"batch={COMPACT}-{uuid.uuid4().hex[:12]}"
            old = [f for b in bins for f in b]
            plan, number = [], 0
            for i, files in enumerate(bins):
                folder = files[0]["path"].split("/", 1)[1].rsplit("/", 1)[0]
                for f in files:
                    plan.append((f"{folder}/{i:06d}", number, None, f["path"]))
                    number += 1
            planned = self.spark.createDataFrame(plan, "bin string, file_no bigint, num_rows bigint, path string")
            report = smallfiles.compact_files(planned, f"{self.folder.uri}/data", f"{self.folder.uri}/data/{batch}", min(len(bins), shuffle_partitions(self.spark)))
            made: dict[str, dict] = {}
            for row in report.select("file_no", "out_path", "out_bytes").collect():  # one row per small file, as the log itself has
                by = old[row["file_no"]]["by"]
                known = made.setdefault(row["out_path"], _entry(f"{batch}/{row['out_path']}", row["out_bytes"], by))
                if known["by"] != by:
                    known["by"] = APPEND
            self._commit(base, list(made.values()), old, COMPACT)
        return len(old) - len(made)

    def vacuum(self, retention: timedelta = timedelta(0)) -> int:
        """Delete data files that the current version does not name and that are older than ``retention``. No append is under way meanwhile."""
        with self.lock():
            named = {f["path"] for f in self.files()}
            limit = (_now() - retention).timestamp() * 1000
            count = 0
            for path, changed in list(self.folder.walk("data", times=True)):
                if path not in named and changed <= limit:
                    self.folder.delete(f"data/{path}")
                    count += path.endswith(".parquet")
            return count

    def destroy(self) -> None:
        """Forget the table; its files are left to :meth:`vacuum`."""
        with self.lock():
            self.folder.delete("log")
            self.folder.delete("tags")

    # ---- fence: one maintenance run at a time, and none while an append is under way

    @contextmanager
    def appending(self) -> Iterator[None]:
        """Register, then look for the lock; withdraw and try again while it is held."""
        marker = f"appending/{uuid.uuid4().hex}"

        def register() -> bool:
            self.folder.create(marker, _now().isoformat())
            if not self.folder.exists(".LOCK"):
                return True
            self.folder.delete(marker)
            return False

        self._await(register, "the table is locked")
        try:
            yield
        finally:
            self.folder.delete(marker)

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Take the lock, then wait until no append is under way."""
        self._await(lambda: self.folder.create(".LOCK", _now().isoformat()), "the table is locked")
        try:
            self._await(lambda: not self.folder.names("appending"), "an append is under way")
            yield
        finally:
            self.folder.delete(".LOCK")

    #: seconds between tries (growing) and their number
    WAIT, TRIES = 0.05, 22

    def _await(self, ready: Callable[[], bool], what: str) -> None:
        for attempt in range(self.TRIES):
            if ready():
                return
            time.sleep(self.WAIT * (attempt + 1))
        raise Conflict(f"{what}; if its process has died, unlock the table")

    def unlock(self) -> bool:
        """Remove the locks a dead process has left."""
        held = self.folder.exists(".LOCK") or bool(self.folder.names("appending"))
        self.folder.delete(".LOCK")
        self.folder.delete("appending")
        return held


def balanced(rows: DataFrame) -> DataFrame:
    """Rows of a partition together; small partitions share a task, and one that holds a third of all rows is split over many."""
    return rows.hint("rebalance", *[F.col(c) for c in PARTITIONS])


def _key(f: dict) -> Key:
    return f["shard"], f["bucket"], f["origin"]


def _entry(path: str, size: int, by: str) -> dict:
    keys = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
    return {"path": path, **{k: unquote(keys[k]) for k in PARTITIONS}, "size": size, "by": by}


def _bins(files: list[dict], target: int, max_files: int) -> list[list[dict]]:
    """Files in order of their paths, cut where a bin would exceed ``target`` bytes or ``max_files``."""
    bins: list[list[dict]] = [[]]
    size = 0
    for f in sorted(files, key=lambda f: f["path"]):
        if bins[-1] and (size + f["size"] > target or len(bins[-1]) >= max_files):
            bins.append([])
            size = 0
        bins[-1].append(f)
        size += f["size"]
    return bins


def _now() -> datetime:
    return datetime.now(timezone.utc)
