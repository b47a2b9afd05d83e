"""The write-ahead journal: a landing folder of parquet batches, drained by Structured Streaming.

Writers add batches; nothing is indexed. A drain is one ``availableNow`` run of
a file stream: its checkpoint claims each landed file once, every micro-batch is
appended to the table, and a run that dies is replayed from the checkpoint. A
batch may then be appended twice, which the merge collapses: at-least-once
delivery, exactly-once state. One drain runs at a time; a second one is refused
until the first has ended or :meth:`Journal.unlock` frees it. Event-time windows
and sessions over a journal are plain stateful operators on top
(:func:`windowed_counts`).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statelake.functions.ids import entity_shard
from statelake.schema import NAMES, NULLABLE, conform, enforce_required
from statelake.sources.files import from_ipc
from statelake.sources.paths import Folder
from statelake.sources.store import Conflict, StatementStore


class Journal:
    def __init__(self, spark: SparkSession, root: str, store: StatementStore):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store
        self.folder = Folder(spark, self.root)

    def add(self, rows: DataFrame) -> None:
        """Land a batch: extra columns are dropped, the shard is derived anew, required columns are enforced."""
        conformed = conform(rows.withColumn("shard", entity_shard(F.col("entity_id"), self.store.shards)))
        enforce_required(conformed).write.mode("append").parquet(f"{self.root}/landing")
        self.store.tags.touch("journal")

    def add_ipc(self, data: bytes) -> None:
        """Land an Arrow stream, as it comes over a wire."""
        self.add(from_ipc(self.spark, data))

    def add_table(self, table: pa.Table) -> None:
        self.add(self.spark.createDataFrame(table))

    def rows(self) -> DataFrame:
        """What has landed and not been drained."""
        if not any(n.endswith(".parquet") for n in self.folder.names("landing")):
            return self.spark.createDataFrame([], NULLABLE)
        return self.spark.read.schema(NULLABLE).parquet(f"{self.root}/landing")

    def entity(self, entity_id: str) -> DataFrame:
        return self.rows().where((F.col("entity_id") == entity_id) & F.col("deleted_at").isNull())

    def count(self) -> int:
        return self.rows().count()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    def clear(self) -> None:
        self.folder.delete("landing")
        self.folder.delete("checkpoint")

    def flush(self, max_files: int = 1000) -> int:
        """Drain to the table; returns the number of rows. Drained files go only after all of them are durable."""
        if not self.folder.create(".FLUSH", uuid.uuid4().hex):
            raise Conflict("another flush is under way; if its process has died, unlock the journal")
        try:
            return self._drain(max_files)
        finally:
            self.folder.delete(".FLUSH")

    def unlock(self) -> bool:
        """Free a drain whose process has died; the next one takes up what it left."""
        held = self.folder.exists(".FLUSH")
        self.folder.delete(".FLUSH")
        return held

    def _drain(self, max_files: int) -> int:
        names = [n for n in self.folder.names("landing") if n.endswith(".parquet")]
        if not names:
            if not self.store.tags.get("optimized"):
                self.store.ensure()
                self.store.tags.touch("optimized")  # else freshness could never be established
            return 0
        counts: list[int] = []

        def sink(batch: DataFrame, _: int) -> None:
            if batch.isEmpty():  # nothing to write, so nothing would be observed
                return
            seen = Observation()
            self.store.append(batch.select(*NAMES).observe(seen, F.count(F.lit(1)).alias("rows")))
            counts.append(seen.get["rows"])

        stream = self.spark.readStream.schema(NULLABLE).option("maxFilesPerTrigger", max_files).parquet(f"{self.root}/landing")
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).queryName(f"flush_{uuid.uuid4().hex[:8]}").start()
        query.awaitTermination()
        for name in names:
            self.folder.delete(f"landing/{name}")
        self.store.tags.touch("flushed")
        return sum(counts)


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts per window and key; on a stream, state older than the watermark is dropped."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return events.withWatermark(time_col, late).groupBy(span, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per key: runs of events with less than ``gap`` between neighbours."""
    rows = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_deliveries(messages: DataFrame, time_col: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """A stream without repeats inside the watermark, with bounded state."""
    return messages.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
