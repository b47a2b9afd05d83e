import random

import pytest
from pyspark.sql import functions as F

from statelake.operators.merge import last_wins, merge, merge_by_windows, merge_range, merge_sliced, sampled_ranges, slice_count, slice_ranges
from tests.helpers import at, statement as s, statements


def rows(df):
    return sorted((r["id"], r["origin"], r["fragment"], r["value"], r["first_seen"], r["last_seen"], r["deleted_at"]) for r in df.collect())


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("how", [merge, merge_by_windows])
class TestMerge:
    def test_latest_wins_and_first_seen_folds(self, spark, how):
        (row,) = how(statements(spark, s(first=0, last=0), s(first=5, last=5))).collect()
        assert (row["first_seen"], row["last_seen"]) == (at(0), at(5))

    def test_tombstones_and_grace(self, spark, how):
        raw = statements(spark, s("old", deleted=1, last=1), s("new", deleted=20, last=20), s("live"))
        assert ids(how(raw, at(1))) == ["live", "new"]
        assert ids(how(raw)) == ["live", "new", "old"]

    def test_partitions_and_origins_are_isolated(self, spark, how):
        raw = statements(spark, s(origin="a"), s(origin="b", last=3), s(shard="1"), s(bucket="pages"))
        assert how(raw).count() == 4

    def test_supersession_keeps_own_first_seen(self, spark, how):
        raw = statements(spark, s("h1", value="1", fragment="f", first=0), s("h2", value="2", fragment="f", first=3))
        (row,) = how(raw).collect()
        assert (row["id"], row["first_seen"]) == ("h2", at(3))

    def test_multi_valued_supersession(self, spark, how):
        raw = statements(spark, *[s(i, fragment="f", first=0) for i in ("h1", "h2")], *[s(i, fragment="f", first=2) for i in ("h3", "h4")])
        assert ids(how(raw)) == ["h3", "h4"]

    def test_property_missing_from_re_emission_survives(self, spark, how):
        raw = statements(spark, s("n1", prop="name", fragment="f"), s("c1", prop="country", fragment="f"), s("n2", prop="name", fragment="f", first=2))
        assert ids(how(raw)) == ["c1", "n2"]

    def test_jitter_keeps_only_the_newest(self, spark, how):
        assert ids(how(statements(spark, s("a", fragment="f", first=0), s("b", fragment="f", first=0.0001)))) == ["b"]

    def test_fragments_are_isolated(self, spark, how):
        assert how(statements(spark, s(fragment="f"), s(fragment="g"), s(fragment=""))).count() == 3

    def test_fragment_tombstone_takes_its_group(self, spark, how):
        raw = statements(spark, s("a", fragment="f"), s("b", fragment="f"), s("a", fragment="f", last=4, deleted=4))
        assert [(r["id"], r["deleted_at"]) for r in how(raw).collect()] == [("a", at(4))]
        assert how(raw, at(4)).count() == 0

    def test_tombstone_wins_a_tie(self, spark, how):
        raw = statements(spark, s("a"), s("a", deleted=0), s("b", fragment="f"), s("b", fragment="f", deleted=0))
        assert how(raw, at(1)).count() == 0

    def test_repeats_collapse_and_merging_twice_changes_nothing(self, spark, how):
        raw = statements(spark, s(), s(), s("x", fragment="f", first=1), s("x", fragment="f", first=1))
        once = how(raw)
        assert once.count() == 2 and rows(how(once)) == rows(once)

    def test_nulls_and_empty(self, spark, how):
        assert how(statements(spark)).count() == 0
        raw = statements(spark, s(prop=None, value=None), s("n", first=None), s("e", entity=None), s("f", fragment=None))
        assert how(raw).count() == 4


def random_log(spark, seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        e, p, v = rng.randrange(6), rng.choice(["name", "alias"]), rng.randrange(3)
        out.append(s(f"{e}-{p}-{v}", f"e{e}", p, str(v), first=rng.randrange(5), fragment=rng.choice(["", "", "f", "g"]), deleted=None, origin=rng.choice("ab"), original_value=rng.choice([None, "x", "y"])))
        if rng.random() < 0.15:
            out[-1]["deleted_at"] = out[-1]["last_seen"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_aggregates_equal_windows_in_any_order(spark, seed):
    log = random_log(spark, seed)
    want = rows(merge_by_windows(statements(spark, *log)))
    random.Random(seed).shuffle(log)
    assert rows(merge(statements(spark, *log).repartition(7))) == want


def test_hot_entity_needs_no_window(spark):
    plan = merge(statements(spark, s()))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_ranges_tile_the_merge(spark):
    log = random_log(spark, 9)
    raw = statements(spark, *log)
    ranges = slice_ranges([r["entity_id"] for r in log], 4)
    assert ranges[0][0] is None and ranges[-1][1] is None
    parts = [r for lo, hi in ranges for r in rows(merge_range(raw, lo, hi))]
    assert sorted(parts, key=str) == sorted(rows(merge(raw)), key=str)


def test_slices_follow_the_ids_of_the_table(spark):
    """Bounds come from the ids, whatever their prefixes, and rows without an entity are in one slice."""
    log = [s(f"s{i}", f"zz{i % 40:02d}", value=str(i), first=float(i % 7)) for i in range(200)] + [s("none", None, first=1), s("none", None, first=2)]
    raw = statements(spark, *log)
    ranges = sampled_ranges(raw, 4)
    sizes = [len(rows(merge_range(raw, lo, hi))) for lo, hi in ranges]
    assert len(ranges) == 4 and min(sizes) > 30 and sum(sizes) == 201
    assert sorted(rows(merge_sliced(raw, 4)), key=str) == sorted(rows(merge(raw)), key=str)
    assert rows(merge_sliced(raw.limit(0), 4)) == []


def test_slice_helpers():
    assert slice_ranges(["a"] * 10, 4) == [(None, None)]
    assert slice_ranges([], 3) == [(None, None)]
    assert slice_count(15 * 10**9, 64 * 10**9) == 8
    assert slice_count(1, "8GB") == 1 and slice_count(10**9, "rubbish") == 4


def test_last_wins(spark):
    df = statements(spark, s(value="a"), s(value="b"), s("t")).withColumn("n", F.when(F.col("value") == "b", 1).otherwise(0))
    assert sorted((r["id"], r["value"]) for r in last_wins(df, "n").collect()) == [("s1", "b"), ("t", "v")]


def test_asof_join_equals_brute_force(spark):
    """A hot key over many buckets, ties, nulls, repeats, clashing names and empty sides."""
    import random

    from pyspark.sql import functions as F

    from statelake.operators.asof import asof_join

    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "a", "b", "only", None])
    when = lambda: None if rng.random() < 0.05 else at(rng.randrange(80) / 4)
    left = [(i, key(), when(), "l") for i in range(400)] + [(0, "hot", at(5), "l")] * 2
    right = [(i, "x" if (k := key()) == "only" else k, when(), f"r{i % 9}") for i in range(150)] + [(7, "hot", at(5), "r0")] * 2
    schema = "n int, k string, t timestamp_ntz, carried string"
    got = asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "t", "t").collect()

    def brute(k, t):
        found = [(u, n, v) for n, j, u, v in right if k is not None and t is not None and j == k and u is not None and u <= t]
        return max(found, default=None)

    want = [(*r, brute(r[1], r[2])) for r in left]
    assert sorted(((*r[:4], None if r[4] is None else tuple(r[4])) for r in got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], schema)
    assert asof_join(empty, empty, "k", "t", "t").count() == 0
    assert asof_join(spark.createDataFrame(left, schema), empty, "k", "t", "t").where(F.col("matched").isNull()).count() == len(left)
