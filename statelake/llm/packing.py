"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths, not over items: a best-fit
decreasing pass handles all items of one length at a time and keeps containers
in classes (equal content, one count). A histogram has at most ``capacity``
lengths, so the plan is small whatever the corpus. It assigns to every length
consecutive ranges of ranks, each range going to one class of containers.

Items then get a rank within their length and take the slot planned for that
rank. Ranks are made in two steps (counts per length and hash slice, then a rank
inside the slice), so a length shared by a third of all items is never ordered
in one task.

Edge cases: items of null or no length are left out; an item longer than the
capacity is split into full pieces and one rest, nothing else is split;
repeated keys are separate items only if ``item`` values differ; empty input
gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statelake.session import shuffle_partitions


@dataclass
class Slots:
    """Ranks ``[start, stop)`` of one length go to containers from ``first`` on, ``per`` to each."""

    length: int
    start: int
    stop: int
    first: int
    per: int


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Classes of containers: ``(number of containers, {length: items of it in each})``. Best fit, longest first."""
    open_at: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []  # the keys of open_at, ascending
    done: list[tuple[int, dict[int, int]]] = []

    def put(count: int, content: dict[int, int], room: int) -> None:
        if room == 0:
            done.append((count, content))
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, content = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, count, content = capacity, -(-left // (capacity // length)), {}
            per = min(room // length, left)
            used = min(count, left // per)
            put(used, content | {length: per}, room - per * length)
            left -= used * per
            if count > used and (content or left):
                if content:
                    put(count - used, content, room)
    return done + [entry for room in rooms for entry in open_at[room]]


def slot_table(classes: list[tuple[int, dict[int, int]]]) -> list[Slots]:
    """The ranges of ranks that each class of containers takes from each length."""
    taken: dict[int, int] = {}
    slots, first = [], 0
    for count, content in classes:
        for length, per in content.items():
            start = taken.get(length, 0)
            taken[length] = start + count * per
            slots.append(Slots(length, start, taken[length], first, per))
        first += count
    return slots


def pieces(items: DataFrame, item: str, length: str, capacity: int) -> DataFrame:
    """``item, piece_no, token_from, n_tokens``: each item, split only where it exceeds the capacity."""
    number = F.ceil(F.col(length) / capacity).cast("int")
    cut = items.where(F.col(length) > 0).select(F.col(item).alias("item"), F.col(length).cast("long").alias("total"), F.explode(F.sequence(F.lit(0), number - 1)).alias("piece_no"))
    start = (F.col("piece_no") * F.lit(capacity)).cast("long")
    return cut.select("item", "piece_no", start.alias("token_from"), F.least(F.lit(capacity).cast("long"), F.col("total") - start).alias("n_tokens"))


def pack(items: DataFrame, capacity: int, item: str = "doc_id", length: str = "n_tokens") -> DataFrame:
    """``item, piece_no, token_from, n_tokens, container_no``. ``items`` is read three times, so it should be staged."""
    spark = items.sparkSession
    slices = shuffle_partitions(spark)
    cut = pieces(items, item, length, capacity).withColumn("slice", F.pmod(F.xxhash64("item", "piece_no"), F.lit(slices)))
    counts = cut.groupBy("n_tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    # at most `capacity` rows reach the driver, whatever the corpus
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(plan_containers(histogram, capacity))
    rows = [(s.length, s.start, s.stop, s.first, s.per) for s in slots]
    planned = spark.createDataFrame(rows, "n_tokens bigint, start bigint, stop bigint, first bigint, per bigint")
    # one row per length, at most `capacity`: an item meets one row and finds its range inside it
    planned = planned.groupBy("n_tokens").agg(F.array_sort(F.collect_list(F.struct("start", "first", "per"))).alias("slots"))
    before = Window.partitionBy("n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("item", "piece_no")) - 1
    ranked = cut.withColumn("inside", inside).join(offsets, ["n_tokens", "slice"]).withColumn("rank", F.col("offset") + F.col("inside"))
    slot = F.try_element_at(F.filter("slots", lambda s: s["start"] <= F.col("rank")), F.lit(-1))
    placed = ranked.join(planned, "n_tokens").withColumn("slot", slot)
    container = F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.start")) / F.col("slot.per"))
    return placed.select("item", "piece_no", "token_from", "n_tokens", container.cast("long").alias("container_no"))
