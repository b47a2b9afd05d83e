"""Exactly one copy of each message of an at-least-once feed.

Plan
----
1. ``keyed``: every message is reduced to its normalised identifier, a 64-bit
   hash and the time bucket in which it arrived. Copies inside one bucket
   collapse in a hash aggregate with map-side combine, so one identifier that
   makes up a third of the feed costs one row per task.
2. The reduced rows are stored once, partitioned by time bucket and in order of
   hash. This is the *bucketed storage*.
3. ``screen``: one task per hash slice reads hashes in order of time with one
   Bloom filter per bucket. Identifiers that no earlier filter knows are
   definitely new; for the rest it names the buckets whose filters matched, and
   of a message repeated inside its bucket that bucket. The task holds filters,
   some three bytes an identifier, and never the hashes; slices have about
   ``SLICE_ROWS`` rows, however many there are.
4. The storage is read once more. Rows with a (bucket, hash) that was named are
   compared by their exact identifiers, all others are dropped in the scan's task.

Wide rows of messages that were delivered once are never shuffled: they pass an
anti join against the (few) verified repeats.

Edge cases: ``id`` is compared in lower case without surrounding white space, a
null or missing ``fragment`` is ``''``; ``origin`` is compared exactly and a null
origin equals a null origin; a message whose ``id`` is null or blank has no
identity, is never a repeat and is always kept; a null arrival time forms a
bucket of its own; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from statelake.session import Scratch, shuffle_partitions

BUCKET_SECONDS = 6 * 3600
BITS_PER_KEY = 12
PROBES = 6
SLICE_ROWS = 4_000_000

_SUSPECT = "__h bigint, __tb bigint"


def normal_id(column: Column) -> Column:
    """A hexadecimal identifier in lower case without surrounding white space; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


class BloomFilter:
    """A plain Bloom filter over 64-bit hashes, vectorised with numpy."""

    def __init__(self, expected: int, bits_per_key: int = BITS_PER_KEY, probes: int = PROBES):
        self.probes = probes
        self.m = np.uint64(max(64, int(expected) * bits_per_key))
        self.bits = np.zeros(int(self.m) // 8 + 1, dtype=np.uint8)

    def _positions(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            a = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            b = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
            a ^= a >> np.uint64(33)
            b ^= b >> np.uint64(32)
            return np.stack([(a + np.uint64(i) * b) % self.m for i in range(self.probes)])

    def add(self, keys: np.ndarray) -> None:
        pos = self._positions(keys)
        np.bitwise_or.at(self.bits, (pos >> np.uint64(3)).astype(np.int64), (1 << (pos & np.uint64(7))).astype(np.uint8))

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        pos = self._positions(keys)
        hit = self.bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)
        return (hit & 1).all(axis=0)


class GrowingFilter:
    """Bloom filters of doubling size for a number of keys that is not known before."""

    FIRST = 1 << 12

    def __init__(self):
        self.parts: list[BloomFilter] = []
        self.room = 0

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            if not self.room:
                self.room = self.FIRST << len(self.parts)
                self.parts.append(BloomFilter(self.room))
            taken, keys = keys[: self.room], keys[self.room :]
            self.parts[-1].add(taken)
            self.room -= len(taken)

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(keys), dtype=bool)
        for part in self.parts:
            hit |= part.might_contain(keys)
        return hit


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash slice in order of time (hash, bucket, copies): (hash, bucket) of every possible repeat and of the buckets that may hold its earlier copy."""
    known = GrowingFilter()  # all buckets together: most keys need this one probe only
    earlier: list[tuple[int, GrowingFilter]] = []
    own, now = GrowingFilter(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, tb, n = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        starts = np.flatnonzero(np.r_[True, tb[1:] != tb[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(tb)]):
            if now != int(tb[lo]):
                if now is not None:
                    earlier.append((now, own))
                own, now = GrowingFilter(), int(tb[lo])
            keys = h[lo:hi]
            inside = n[lo:hi] > 1
            if inside.any():
                yield _rows(keys[inside], now)
            possible = keys[known.might_contain(keys)]
            if len(possible):
                matched = np.zeros(len(possible), dtype=bool)
                for bucket, seen in earlier:
                    hit = seen.might_contain(possible)
                    matched |= hit
                    if hit.any():
                        yield _rows(possible[hit], bucket)
                if matched.any():
                    yield _rows(possible[matched], now)
            own.add(keys)
            known.add(keys)


def _rows(keys: np.ndarray, bucket: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), bucket, dtype=np.int64))], names=["__h", "__tb"])


def keyed(df: DataFrame, time_col: str, bucket_seconds: int) -> DataFrame:
    """One row per message: hash, time bucket, normalised identifier, and the whole message as ``__row``."""
    return df.select(
        normal_id(F.col("id")).alias("__id"),
        F.col("origin").alias("__origin"),
        F.coalesce(F.col("fragment"), F.lit("")).alias("__fragment"),
        F.coalesce(F.floor(F.col(time_col).cast("timestamp").cast("long") / F.lit(bucket_seconds)), F.lit(-1)).cast("long").alias("__tb"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
    ).withColumn("__h", F.xxhash64("__id", "__origin", "__fragment"))


def repeated_messages(df: DataFrame, time_col: str = "received_at", bucket_seconds: int = BUCKET_SECONDS, slices: int | None = None) -> DataFrame:
    """``id, origin, fragment, copies`` of every message that was delivered more than once."""
    spark = df.sparkSession
    scratch = Scratch(spark, "deliveries")
    keys = (
        keyed(df, time_col, bucket_seconds)
        .where(F.col("__id").isNotNull())
        .groupBy("__tb", "__h", "__id", "__origin", "__fragment")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    seen = Observation()
    placed = keys.hint("rebalance", F.col("__tb")).sortWithinPartitions("__tb", "__h").observe(seen, F.count(F.lit(1)).alias("rows"))
    storage = scratch.stage(placed, "storage", ["__tb"])
    slices = slices or max(shuffle_partitions(spark), -(-seen.get["rows"] // SLICE_ROWS))
    hashes = storage.select("__h", "__tb", "__n").repartition(slices, "__h").sortWithinPartitions("__tb")
    suspects = scratch.stage(hashes.mapInArrow(_screen, _SUSPECT), "suspects")
    return (
        storage.join(suspects.distinct(), ["__tb", "__h"], "left_semi")
        .groupBy(F.col("__id").alias("id"), F.col("__origin").alias("origin"), F.col("__fragment").alias("fragment"))
        .agg(F.sum("__n").alias("copies"))
        .where("copies > 1")
    )


def dedupe_messages(df: DataFrame, time_col: str = "received_at", order: tuple[str, ...] = ("received_at", "message_no"), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The feed with exactly one row per message: the first to arrive, ties by ``order``; all columns kept."""
    scratch = Scratch(df.sparkSession, "deliveries")
    repeats = scratch.stage(repeated_messages(df, time_col, bucket_seconds).select(F.xxhash64("id", "origin", "fragment").alias("__h")).distinct(), "repeats")
    rows = keyed(df, time_col, bucket_seconds)
    once = rows.join(repeats, "__h", "left_anti").select("__row.*")
    nobody = rows.where("__id is null").join(repeats, "__h", "left_semi").select("__row.*")
    first = (
        rows.where("__id is not null")
        .join(repeats, "__h", "left_semi")
        .groupBy("__id", "__origin", "__fragment")
        .agg(F.min(F.struct(*[F.col(f"__row.{c}").alias(f"o{i}") for i, c in enumerate(order)], F.col("__row").alias("row"))).alias("best"))
        .select("best.row.*")
    )
    return once.unionByName(nobody).unionByName(first)
