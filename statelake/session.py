"""Session settings and the shared scratch area used to cut lineage.

Iterative operators write each round as a parquet table below the folder named
by ``spark.checkpoint.dir``, which every executor shares, so that a lost
executor costs a re-read and not a re-computation. Only where that setting is
absent (tests, notebooks) a local temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_ROOTS: set[str] = set()


def build_session(app: str = "statelake", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every operator is tuned for."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a local one if none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared.rstrip("/"))
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="statelake-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


class Scratch:
    """Tables of one operator run, under one folder of the shared scratch area."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, spark, self.root)
        _ROOTS.add(self.root)
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def stage(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        out = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(out)
        read = self.spark.read.schema(df.schema).parquet(out)
        read._scratch_path = out  # type: ignore[attr-defined]
        return read

    def stage_bucketed(self, df: DataFrame, key: str, buckets: int, partition_by: str) -> DataFrame:
        """Write ``df`` bucketed and sorted by ``key``, so that grouping and joining by it needs no shuffle. One file per bucket and partition."""
        name = f"scratch_{uuid.uuid4().hex}"
        placed = df.repartition(buckets, key).sortWithinPartitions(partition_by, key)
        writer = placed.write.option("path", self.path("bucketed")).option("compression", "zstd").partitionBy(partition_by)
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        atexit.register(_forget_table, self.spark, name)
        return self.spark.table(name)

    def keep_bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Write ``df``, which lies in ``buckets`` by ``key`` already, as it lies."""
        name = f"scratch_{uuid.uuid4().hex}"
        df.write.option("path", self.path("bucketed")).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        atexit.register(_forget_table, self.spark, name)
        return self.spark.table(name)

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                delete_path(self.spark, path)


def _forget_table(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001 - as in _forget
        pass


def _forget(spark: SparkSession, root: str) -> None:
    """Results may read staged tables until the program ends; then they go."""
    try:
        delete_path(spark, root)
    except Exception:  # noqa: BLE001 - the session may be gone already, and its folder with it
        pass


def clear_scratch(spark: SparkSession) -> int:
    """Delete everything staged so far, in a session that goes on; results that read staged tables must have been taken. Returns the number of runs."""
    count = len(_ROOTS)
    while _ROOTS:
        delete_path(spark, _ROOTS.pop())
    return count


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="statelake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(folder, f"statelake-{context.applicationId}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for here, _, names in os.walk(package):
            for name in names:
                if name.endswith((".py", ".json")):
                    path = os.path.join(here, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
