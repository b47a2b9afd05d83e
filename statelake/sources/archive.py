"""A content-addressed archive of files, with one metadata record per path and checksum."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import mimetypes
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelake.functions.values import safe_name, validate_checksum, validate_origin
from statelake.session import Scratch
from statelake.sources.blobs import Store
from statelake.sources.paths import Folder

META = (
    "id string, dataset string, checksum string, key string, name string, store string, size bigint, mimetype string, origin string, "
    "extra map<string,string>, created_at timestamp, updated_at timestamp"
)
POLICIES = ("overwrite", "skip-path", "skip-checksum")


def key_folder(checksum: str) -> str:
    validate_checksum(checksum)
    return f"archive/{checksum[:2]}/{checksum[2:4]}/{checksum[4:6]}/{checksum}"


class Archive:
    def __init__(self, spark: SparkSession, root: str, dataset: str):
        self.spark, self.root, self.dataset = spark, root.rstrip("/"), dataset
        self.folder = Folder(spark, self.root)

    # ---- reading

    def files(self) -> DataFrame:
        """All metadata records, read in parallel."""
        if not self.folder.exists("archive"):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{self.root}/archive")

    def records(self, checksum: str) -> list[dict]:
        folder = key_folder(checksum)
        return [json.loads(self.folder.read(f"{folder}/{n}")) for n in self.folder.names(folder) if n.endswith(".json")]

    def blobs(self, checksums: list[str] | None = None) -> DataFrame:
        """``checksum, content`` of blobs, read by the executors."""
        where = [f"{self.root}/{key_folder(c)}/blob" for c in checksums] if checksums is not None else [f"{self.root}/archive/*/*/*/*/blob"]
        found = self.spark.read.format("binaryFile").load(where)
        return found.select(F.regexp_extract("path", r"([0-9a-f]{64})/blob$", 1).alias("checksum"), "content")

    def exists(self, checksum: str) -> bool:
        return self.folder.exists(f"{key_folder(checksum)}/blob")

    def open(self, checksum: str):
        """A stream over a blob."""
        return Store(self.folder.uri).open(f"{key_folder(checksum)}/blob")

    def stream(self, checksum: str, chunk: int = 1 << 20) -> Iterator[bytes]:
        with self.open(checksum) as stream:
            while part := stream.read(chunk):
                yield part

    def local_path(self, checksum: str) -> str | None:
        """The blob's path on this machine; ``None`` if it lies elsewhere."""
        store = Store(self.folder.uri)
        return store.path(f"{key_folder(checksum)}/blob") if store.fs.type_name == "local" else None

    def text(self, checksum: str, origin: str | None = None) -> str | None:
        """Extracted text of one origin, or of the first that has one."""
        folder = key_folder(checksum) + "/txt"
        names = [f"{validate_origin(origin)}.txt"] if origin else self.folder.names(folder)
        for name in names:
            if self.folder.exists(f"{folder}/{name}"):
                return self.folder.read(f"{folder}/{name}")
        return None

    # ---- writing

    def store(self, path: str, content: bytes, origin: str = "default", mimetype: str | None = None, **extra: str) -> dict:
        """Keep the content once per checksum and a record per path."""
        validate_origin(origin)
        checksum = hashlib.sha256(content).hexdigest()
        folder = key_folder(checksum)
        if not self.folder.exists(f"{folder}/blob"):
            self._put(f"{folder}/blob", content)
        return self._record(path, checksum, len(content), origin, mimetype, extra)

    def _record(self, path: str, checksum: str, size: int, origin: str, mimetype: str | None, extra: dict) -> dict:
        made = record(self.root, self.dataset, path, checksum, size, origin, mimetype, extra)
        target = f"{key_folder(checksum)}/{made['id']}.json"
        if self.folder.exists(target):
            made["created_at"] = json.loads(self.folder.read(target))["created_at"]
        self.folder.write(target, json.dumps(made))
        return made

    def _put(self, name: str, content: bytes) -> None:
        target = self.folder._path(name)
        self.folder._fs.mkdirs(target.getParent())
        stream = self.folder._fs.create(target, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def put_text(self, checksum: str, text: str, origin: str = "default") -> None:
        self.folder.write(f"{key_folder(checksum)}/txt/{validate_origin(origin)}.txt", text)

    def put_data(self, checksum: str, name: str, text: str) -> None:
        self.folder.write(f"{key_folder(checksum)}/data/{safe_name(name)}", text)

    def delete(self, record: dict) -> None:
        """Remove a record, and the blob with the last record of its checksum."""
        folder = key_folder(record["checksum"])
        self.folder.delete(f"{folder}/{record['id']}.json")
        if not self.records(record["checksum"]):
            self.folder.delete(folder)

    # ---- crawling and downloading: tasks move the bytes, the driver sees none of them

    def crawl(self, source: str, origin: str = "crawl", prefix: str = "", exclude_prefix: str | None = None, glob: str | None = None, exclude_glob: str | None = None, policy: str = "skip-path") -> DataFrame:
        """Take up the files below ``source``; returns the records made.

        Paths and sizes are listed first; what is excluded, and under ``skip-path`` what is known, is left out before any
        content is read. The rest is read, hashed and stored where it is read; under ``skip-checksum`` known contents are
        left out in between. A repeated task stores the same blobs and records again.
        """
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        validate_origin(origin)
        here = Folder(self.spark, source)
        base = here._fs.getFileStatus(here._path("")).getPath().toString().rstrip("/") + "/"
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
        keyed = found.select(F.expr(f"substring(path, {len(base) + 1})").alias("key"), "content").where(F.col("key").startswith(prefix))
        if exclude_prefix:
            keyed = keyed.where(~F.col("key").startswith(exclude_prefix))
        if glob:
            keyed = keyed.where(F.col("key").rlike(_regex(glob)))
        if exclude_glob:
            keyed = keyed.where(~F.col("key").rlike(_regex(exclude_glob)))
        if policy == "skip-path":
            keyed = keyed.drop("content").join(self.files().select("key").distinct(), "key", "left_anti")
        else:
            keyed = keyed.drop("content")
        paths = Scratch(self.spark, "crawl").stage(keyed, "paths")
        source, root, dataset = here.uri, self.folder.uri, self.dataset
        known: DataFrame | None = None
        if policy == "skip-checksum":
            hashed = paths.mapInArrow(_hashed(source), "key string, checksum string")
            known = Scratch(self.spark, "crawl").stage(hashed.join(self.files().select("checksum").distinct(), "checksum", "left_anti").select("key"), "paths")
        made = (paths if known is None else known).select("key").mapInArrow(_stored(source, root, dataset, origin), META.replace("extra map<string,string>, ", "").replace("timestamp", "string"))
        return Scratch(self.spark, "crawl").stage(made, "records")

    def download(self, target: str) -> DataFrame:
        """Copy blobs to readable paths below ``target``; what is there already is skipped. Returns the keys copied.

        Of several contents of one key the newest record counts.
        """
        newest = self.files().where("key is not null").groupBy("key").agg(F.max_by("checksum", F.struct("updated_at", "checksum")).alias("checksum"))
        root, target = self.folder.uri, Folder(self.spark, target).uri

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, goal = Store(root), Store(target)
            for batch in batches:
                for key, checksum in zip(*[c.to_pylist() for c in batch.columns]):
                    if not goal.exists(key):
                        goal.put(key, source.read(f"{key_folder(checksum)}/blob"))
                        yield pa.RecordBatch.from_arrays([pa.array([key])], names=["key"])

        return Scratch(self.spark, "download").stage(newest.select("key", "checksum").mapInArrow(copy, "key string"), "copied")


def _hashed(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(source)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([_digest(store, k) for k in keys], pa.string())], names=["key", "checksum"])

    return run


def _digest(store: Store, key: str) -> str:
    """The hash of a file, read chunk by chunk."""
    state = hashlib.sha256()
    with store.open(key) as stream:
        while chunk := stream.read(1 << 20):
            state.update(chunk)
    return state.hexdigest()


def _stored(source: str, root: str, dataset: str, origin: str):
    names = ["id", "dataset", "checksum", "key", "name", "store", "size", "mimetype", "origin", "created_at", "updated_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, archive = Store(source), Store(root)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                content = store.read(key)
                checksum = hashlib.sha256(content).hexdigest()
                if not archive.exists(f"{key_folder(checksum)}/blob"):
                    archive.put(f"{key_folder(checksum)}/blob", content)
                row = record(root, dataset, key, checksum, len(content), origin, mimetypes.guess_type(key)[0], {})
                target = f"{key_folder(checksum)}/{row['id']}.json"
                if archive.exists(target):
                    row["created_at"] = json.loads(archive.read(target))["created_at"]
                archive.put(target, json.dumps(row).encode())
                columns = [pa.array([row[n]], pa.int64() if n == "size" else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def record(root: str, dataset: str, path: str, checksum: str, size: int, origin: str, mimetype: str | None, extra: dict) -> dict:
    """The metadata of one file: its id hashes path and content."""
    now = datetime.now(timezone.utc).isoformat()
    file_id = "file-" + hashlib.sha256((path + checksum).encode()).hexdigest()
    return {"id": file_id, "dataset": dataset, "checksum": checksum, "key": path, "name": path.rsplit("/", 1)[-1], "store": root, "size": size, "mimetype": mimetype, "origin": origin, "extra": extra, "created_at": now, "updated_at": now}


def _regex(glob: str) -> str:
    """A glob as a pattern both Python and Java read; ``*`` also matches separators."""
    return "^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"
