"""The data-processing operators against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from statelake.operators import changes, deliveries, hierarchy, increments, skew, widen
from statelake.plans import problems
from tests.helpers import T0, at

# ---- messages delivered more than once

JOURNAL = "message_no bigint, received_at timestamp_ntz, id string, origin string, fragment string, value string, __h string, copies string"


def journal(spark, rows):
    return spark.createDataFrame([(n, *r, "x", None) for n, r in enumerate(rows)], JOURNAL)


def brute_repeats(rows):
    count = Counter((i.strip().lower(), o, f or "") for _, i, o, f, _ in rows if i and i.strip())
    return {k for k, n in count.items() if n > 1}


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        key = rng.choice(["aa", "bb"]) if rng.random() < 0.3 else f"{rng.randrange(2500):x}"
        key = rng.choice([key, key.upper(), f" {key}\t"])
        rows.append((at(rng.random() * 5), key, rng.choice(["o", "p", None]), rng.choice(["", None, "f"]), str(rng.random())))
    df = journal(spark, rows)
    found = {(r["id"], r["origin"], r["fragment"]) for r in deliveries.repeated_messages(df).select("id", "origin", "fragment").collect()}
    assert found == brute_repeats(rows)
    kept = deliveries.dedupe_messages(df)
    assert kept.columns == df.columns
    want = {}
    for n, (t, i, o, f, _) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        want.setdefault((i.strip().lower(), o, f or ""), n)
    assert sorted(r["message_no"] for r in kept.collect()) == sorted(want.values())


def test_messages_without_identity_are_kept(spark):
    df = journal(spark, [(None, None, "o", "", "a"), (None, None, "o", "", "a"), (at(0), " ", "o", "", "b"), (at(0), "aa", None, None, "c"), (None, "AA ", None, "", "d")])
    assert [tuple(r)[:3] for r in deliveries.repeated_messages(df).collect()] == [("aa", None, "")]
    assert sorted(r["value"] for r in deliveries.dedupe_messages(df).collect()) in (["a", "a", "b", "c"], ["a", "a", "b", "d"])
    assert deliveries.dedupe_messages(df.limit(0)).count() == 0 and deliveries.repeated_messages(df.limit(0)).count() == 0


def test_bloom_filter_has_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(0)
    keys, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    bloom = deliveries.BloomFilter(len(keys))
    bloom.add(keys)
    assert bloom.might_contain(keys).all()
    assert bloom.might_contain(others).mean() < 0.02


def test_filters_grow_and_the_screen_names_both_copies():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63 - 1, 30_000), rng.integers(-(2**63), 2**63 - 1, 5000)
    grown = deliveries.GrowingFilter()
    for part in np.array_split(keys, 7):
        grown.add(part)
    assert grown.might_contain(keys).all() and len(grown.parts) == 4 and grown.might_contain(others).mean() < 0.05
    h = np.r_[keys[:100], keys[50:200], keys[190:300]]
    tb = np.r_[np.full(100, 1), np.full(150, 2), np.full(110, 5)]
    n = np.ones(360, dtype=np.int64)
    n[355] = 3
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + 33]), pa.array(tb[i : i + 33]), pa.array(n[i : i + 33])], names=["h", "tb", "n"]) for i in range(0, 360, 33)]
    named = {(k, b) for out in deliveries._screen(iter(batches)) for k, b in zip(*[c.to_pylist() for c in out.columns])}
    want = {(int(k), b) for part, buckets in ((keys[50:100], (1, 2)), (keys[190:200], (2, 5)), (h[355:356], (5,))) for k in part for b in buckets}
    assert want <= named and len(named) < len(want) + 20


# ---- heavy keys


def test_key_states_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(n, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c" * 300]), at(rng.randrange(40) / 7) if rng.random() > 0.1 else None) for n in range(5000)]
    rows.append((5000, "only-null", None))
    df = spark.createDataFrame(rows, "n bigint, k string, t timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = {r["key_value"]: tuple(r)[1:] for r in skew.key_states(df, "k", "t", "n", 9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for _, k, t in rows:
        groups[k].append(t)
    us = lambda t: round((t - T0).total_seconds() * 1e6) + 1704067200000000
    for k, ts in groups.items():
        seen = sorted(us(t) for t in ts if t is not None)
        gap = max((b - a for a, b in zip(seen, seen[1:])), default=0) if seen else None
        assert got[k] == (len(ts), seen[0] if seen else None, seen[-1] if seen else None, gap), k
    assert len(got) == len(groups)
    assert skew.key_states(df.limit(0), "k", "t", "n").count() == 0


def test_hot_key_spans_partitions(spark):
    df = spark.range(20000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.timestamp_seconds("id").alias("t"))
    ranged = df.repartitionByRange(12, "k", "t", "n").groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in ranged) < 20000 / 12 * 2


# ---- wide tables

PROPS = [("Company", "name", "name", "string", True), ("Company", "since", "date", "date", False), ("Company", "capital", "number", "decimal", False), ("Company", "staff", "number", "integer", False), ("X", "Staff", "number", "integer", False), ("X", "entity_id", "string", "string", False)]
LOG = "id string, origin string, fragment string, entity_id string, prop string, value string, last_seen timestamp_ntz, deleted_at timestamp_ntz, block int"


@pytest.mark.parametrize("block", [1, 2, 16])
def test_wide_rows(spark, block):
    rows = [
        ("1", "o", "", "e", "name", "B", at(0), None), ("2", "o", "", "e", "name", "A", at(0), None), ("2", "p", "", "e", "name", "A", at(0), None),
        ("3", "o", "", "e", "since", "1.2.2020", at(0), None), ("4", "o", "", "e", "since", "2019", at(0), None), ("5", "o", "", "e", "capital", "1.234,5", at(1), None),
        ("6", "o", None, "e", "staff", "07", at(1), None), ("6", "o", None, "e", "staff", "07", at(0), at(0)), ("7", "o", "", "dead", "name", "D", at(0), None), ("7", "o", "", "dead", "name", "D", at(0), at(0)),
        ("8", "o", "", "bare", "id", "x", None, None), ("9", "o", "", None, "name", "N", at(0), None), ("a", "o", "", "e", None, "N", at(0), None), ("b", "o", "", "e", "unknown", "N", at(0), None),
        ("c", "o", "", "other", "Staff", "9", at(0), None), ("d", "o", "", "other", "entity_id", "self", at(0), None), ("e", "o", "", "other", "name", None, at(0), None), ("f", "o", "", "other", "name", "", at(0), None),
    ]
    log = spark.createDataFrame([(*r, 1) for r in rows], LOG)
    registry = spark.createDataFrame(PROPS, "schema string, prop string, prop_type string, cell_type string, many boolean")
    wide = widen.widen(log, registry, block=block)
    got = {r["entity_id"]: r.asDict() for r in wide.collect()}
    assert set(got) == {"e", "bare", "other"}
    assert got["e"] == {"entity_id": "e", "name": "A", "name__n": 2, "since": date(2020, 2, 1), "capital": Decimal("1234.50"), "staff_2": Decimal(7), "Staff": None, "entity_id_2": None}
    assert got["other"]["Staff"] == Decimal(9) and got["other"]["entity_id_2"] == "self" and got["other"]["name"] == "" and got["other"]["name__n"] == 1
    cells = widen.typed_cells(wide, widen.attributes(registry))
    assert sorted(map(tuple, cells.collect())) == [("e", "capital", "1234.50"), ("e", "since", "2020-02-01"), ("e", "staff", "7"), ("other", "Staff", "9")]
    assert widen.widen(log.limit(0), registry).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pivots_and_joins_neither_shuffle_nor_broadcast(spark):
    """Under the session's own settings."""
    log = spark.createDataFrame([("1", "o", "", "e", "name", "B", at(0), None, 1)], LOG)
    registry = spark.createDataFrame(PROPS, "schema string, prop string, prop_type string, cell_type string, many boolean")
    plan = plan_of(widen.widen(log, registry, block=2))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan


def test_thousands_of_attributes(spark):
    props = [("X", f"p{i:04d}", "string", ["string", "date", "decimal", "integer"][i % 4], i % 7 == 0) for i in range(2100)]
    registry = spark.createDataFrame(props, "schema string, prop string, prop_type string, cell_type string, many boolean")
    cell = {"string": "text", "date": "2.1.2020", "decimal": "1,50", "integer": "7"}
    rows = [(f"{e}-{p}", "o", "", f"e{e}", p, cell[kind], at(0), None, 1) for e in range(6) for i, (_, p, _, kind, _) in enumerate(props) if i % 6 == e or e == 0]
    wide = widen.widen(spark.createDataFrame(rows, LOG), registry)
    assert len(wide.columns) == 1 + 2100 + 300
    plan = plan_of(wide)
    assert plan.count("SortMergeJoin") == 6 and "Exchange" not in plan and "Broadcast" not in plan
    got = {r["entity_id"]: r.asDict() for r in wide.collect()}
    assert len(got) == 6 and all(got["e0"][p] is not None for _, p, _, _, _ in props)
    want = {"string": "text", "date": date(2020, 1, 2), "decimal": Decimal("1.50"), "integer": Decimal(7)}
    assert all(got[f"e{e}"][p] == (want[kind] if i % 6 == e else None) for e in range(1, 6) for i, (_, p, _, kind, _) in enumerate(props))


# ---- hierarchies

FOLDERS = "row_no bigint, id string, fileName string, parent string, updated_at timestamp_ntz"
FILES = "row_no bigint, id string, key string, updated_at timestamp_ntz"


def brute_tree(parents):
    out = {}
    for n in parents:
        seen, here = [], n
        while here is not None and here not in seen:
            seen.append(here)
            here = parents[here] if parents[here] in parents else None
        out[n] = (seen[-1], len(seen) - 1) if here is None else (min(seen[seen.index(here) :]), -1)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    parents = {n: (rng.choice(names[max(0, i - 3) : i]) if i and rng.random() < 0.93 else None) for i, n in enumerate(names)}
    chain = [f"c{i:03d}" for i in range(40)]
    parents |= dict(zip(chain, [None, *chain[:-1]]))
    for i, size in enumerate((1, 2, 3, 8)):
        loop = [f"l{i}{j}" for j in range(size)]
        parents |= {a: b for a, b in zip(loop, loop[1:] + loop[:1])}
        parents[f"t{i}"], parents[f"u{i}"] = loop[-1], f"t{i}"
    parents["lost"], parents["empty"] = "nowhere", ""
    rows = [(i, n, n.upper(), p, at(1)) for i, (n, p) in enumerate(parents.items())] + [(999, "c005", "OLD", "l00", at(0)), (1000, None, "x", None, at(0))]
    rows += rows[:5]
    tree = hierarchy.resolve(hierarchy.newest_nodes(spark.createDataFrame(rows, FOLDERS))).select("id", "root_id", "depth", hierarchy.path_text().alias("p")).collect()
    want = brute_tree(parents)
    assert {r["id"]: (r["root_id"], r["depth"]) for r in tree} == want and len(tree) == len(want)
    assert next(r["p"] for r in tree if r["id"] == "c003") == "C000/C001/C002/C003"


def test_files_and_descendants(spark):
    rows = [(1, "r", "root ", None, at(0)), (2, "a", "a", "r", at(0)), (3, "b", None, "a", at(0)), (4, "x", "x", "y", at(0)), (5, "y", "y", "x", at(0))]
    keys = {"f1": "./root //a/f.txt", "f2": "root \\a\\f.txt", "f3": "root/a/f.txt", "f4": "f.txt", "f5": None, "f6": "", "f7": "x/f.txt", "f8": "root /f"}
    files = spark.createDataFrame([(i, k, v, at(0)) for i, (k, v) in enumerate(keys.items())] * 2, FILES)
    folders = spark.createDataFrame(rows, FOLDERS)
    got = {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy.hierarchy_of(folders, files).collect()}
    assert got == {"r": ("r", 0), "a": ("r", 1), "b": ("r", 2), "x": ("x", -1), "y": ("x", -1), "f1": ("r", 2), "f2": ("r", 2), "f3": ("f3", 0), "f4": ("f4", 0), "f5": ("f5", 0), "f6": ("f6", 0), "f7": ("f7", 0), "f8": ("r", 1)}
    resolved = hierarchy.resolve(hierarchy.newest_nodes(folders))
    assert sorted(map(tuple, hierarchy.descendants(resolved).collect())) == [("a", "b", 1), ("r", "a", 1), ("r", "b", 2)]
    assert sorted(map(tuple, hierarchy.descendant_counts(resolved).collect())) == [("a", 1), ("r", 2)]
    assert hierarchy.hierarchy_of(folders.limit(0), files.limit(0)).count() == 0


def test_files_are_nodes_of_the_tree(spark, tmp_path):
    """Each file has a full path, and each folder above it lists it; of equal paths the smallest root, depth and id counts."""
    rows = [(1, "r", "root ", None, at(0)), (2, "a", "a", "r", at(0)), (3, "a2", "a", "r", at(0)), (4, "x", "x", "y", at(0)), (5, "y", "y", "x", at(0)), (6, "both", "both", "r", at(0))]
    keys = {"f1": "./root //a/f.txt", "f2": "root \\g.txt", "f3": "root/a/f.txt", "f4": "h.txt", "f5": None, "f6": "", "f7": "x/f.txt", "both": "root /f"}
    spark.createDataFrame(rows, FOLDERS).write.parquet(f"{tmp_path}/folders.parquet")
    spark.createDataFrame([(i, k, v, at(0)) for i, (k, v) in enumerate(keys.items())] * 2, FILES).write.parquet(f"{tmp_path}/files.parquet")
    paths = {r["id"]: tuple(r)[1:] for r in problems.p4_paths(spark, str(tmp_path)).collect()}
    folders = {"r": ("r", 0, "root "), "a": ("r", 1, "root /a"), "a2": ("r", 1, "root /a"), "both": ("r", 1, "root /both"), "x": ("x", -1, None), "y": ("x", -1, None)}
    alone = {"f3": ("f3", 0, "f.txt"), "f4": ("f4", 0, "h.txt"), "f5": ("f5", 0, ""), "f6": ("f6", 0, ""), "f7": ("f7", 0, "f.txt")}
    assert paths == folders | alone | {"f1": ("r", 2, "root /a/f.txt"), "f2": ("r", 1, "root /g.txt")}
    below = sorted(map(tuple, problems.p4_descendants(spark, str(tmp_path)).collect()))
    assert below == [("a", "f1", 1), ("r", "a", 1), ("r", "a2", 1), ("r", "both", 1), ("r", "f1", 2), ("r", "f2", 1)]


def test_scratch_can_be_cleared(spark):
    import os

    from statelake.session import Scratch, clear_scratch, scratch_root

    staged = Scratch(spark, "cleared").stage(spark.range(3), "t")
    folder = staged._scratch_path.removeprefix("file://")
    assert staged.count() == 3 and os.path.isdir(folder) and folder.startswith(scratch_root(spark).removeprefix("file://"))
    assert clear_scratch(spark) > 0 and not os.path.isdir(folder) and clear_scratch(spark) == 0


# ---- increments

STATEMENTS = "row_no bigint, batch_no bigint, id string, origin string, fragment string, entity_id string, last_seen timestamp_ntz, deleted_at timestamp_ntz"
RUNS = "run_no bigint, from_batch bigint, to_batch bigint, kind string, status string"


def test_increment(spark):
    rows = [
        (1, 1, "a", "o", "", "old", at(1), None), (2, 3, "a", "o", "", "old", at(3), None),  # seen before, only repeated
        (3, 3, "b", "o", "", "new", at(3), None), (4, 1, "c", "o", "", "gone", at(1), None), (5, 3, "c", "o", "", "gone", at(3), at(3)),
        (6, 1, "d", "o", "", "back", at(5), None), (7, 3, "d", "o", "", "back", at(3), at(3)),  # deleted late, but newer row lives
        (8, 1, "e", "o", None, "tie", at(1), None), (9, 3, "e", "o", None, "tie", at(1), at(1)), (10, None, "f", "o", "", "nowhere", at(1), None), (11, 3, "g", None, None, None, None, None),
    ]
    runs = [(1, 1, 2, "entities", "ok"), (1, 1, 2, "entities", "ok"), (2, 3, 3, "entities", "failed"), (3, 3, 3, "documents", "ok"), (4, 3, None, "entities", "ok"), (5, 9, 3, "entities", "ok")]
    statements, history = spark.createDataFrame(rows, STATEMENTS), spark.createDataFrame(runs, RUNS)
    got = dict(map(tuple, increments.increment_after_runs(statements, history).collect()))
    assert got == {"new": "ADD", "gone": "DEL", "back": "ADD", "tie": "DEL"}
    assert increments.increment_after_runs(statements.limit(0), history.limit(0)).count() == 0


def test_runs_neither_skip_nor_repeat(spark, root, monkeypatch):
    manifest, inputs = increments.Manifest(spark, f"{root}/store"), f"{root}/in"
    land = lambda *rows: increments.land(spark.createDataFrame(list(rows), STATEMENTS), inputs)
    run = lambda name: sorted(map(tuple, increments.run_increment(spark, inputs, manifest, name).collect()))
    assert manifest.version() == 0 and run("r0") == [] and manifest.version() == 1
    land((1, 1, "a", "o", "", "e1", at(1), None), (2, 2, "b", "o", "", "e2", at(2), None))
    assert run("r1") == [("e1", "ADD"), ("e2", "ADD")]
    assert run("r2") == []
    land((3, 3, "c", "o", "", "e3", at(3), None), (3, 3, "a", "o", "", "e1", at(3), None))
    # a run that dies after writing and before its commit is repeated in full, under the same identifier or another
    with monkeypatch.context() as m:
        m.setattr(increments.Manifest, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run("r3")
    assert spark.read.parquet(manifest.output_path("r3")).count() == 1
    assert run("r3") == [("e3", "ADD")], "a record that is only seen again is no change"
    # an input that has changed is taken up again, its known records are not reported again
    land((4, 2, "d", "o", "", "e4", at(3), None))
    taken = increments.listing(spark, inputs).where("batch_no = 1").first()["path"]
    more = spark.read.parquet(f"{inputs}/{taken}")
    more = more.unionByName(more.withColumn("id", F.lit("z")).withColumn("entity_id", F.lit("e5"))).toArrow()
    import pyarrow.parquet as pq

    pq.write_table(more, f"{inputs}/{taken}".removeprefix("file://"))
    crc = f"{inputs}/{taken}".removeprefix("file://").rpartition("/")
    import os

    os.remove(f"{crc[0]}/.{crc[2]}.crc")
    assert run("r4") == [("e4", "ADD"), ("e5", "ADD")]
    land((5, 4, "b", "o", "", "e2", at(9), at(9)), (6, 4, "c", "o", "", "e3", at(1), at(1)))
    assert run("r5") == [("e2", "DEL"), ("e3", "ADD")], "a tombstone that is older than the record's newest row changes but does not delete it"
    base = manifest.version()
    with pytest.raises(RuntimeError):
        manifest.commit("r5", base - 1)
    assert manifest.version() == base and run("r6") == []


def test_of_two_runs_one_commits(spark, root):
    from concurrent.futures import ThreadPoolExecutor

    manifest = increments.Manifest(spark, root)
    empty = {"files": spark.createDataFrame([], increments.LISTING), "records": spark.createDataFrame([], increments.STATE)}

    def prepare(name):
        for what, rows in empty.items():
            manifest.prepare(name, what, rows)

    def attempt(name):
        try:
            return manifest.commit(name, 0)
        except RuntimeError:
            return 0

    for name in "ab":
        prepare(name)
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(attempt, "ab")) == [0, 1]
    for version in range(1, increments.SNAPSHOT):
        prepare(f"r{version}")
        manifest.commit(f"r{version}", version)
    assert len(manifest._named("files")) == 1 and manifest.entries().count() == 0 and manifest.records().count() == 0


# ---- change feeds

CHANGES = "change_no bigint, id string, origin string, fragment string, entity_id string, prop string, value string, first_seen timestamp_ntz, last_seen timestamp_ntz, deleted_at timestamp_ntz"


def brute_state(rows):
    keys, groups = defaultdict(list), defaultdict(list)
    for _, i, o, f, e, p, v, _, t, d in rows:
        f = f or ""
        keys[i, o, f].append((t or T0.min, d is not None, e, p))
        groups[o, e, p, f].append(t or T0.min)
    out = set()
    for (i, o, f), seen in keys.items():
        t, dead, e, p = max(seen, key=lambda x: (x[0], x[1]))
        if not dead and (not f or t == max(groups[o, e, p, f])):
            out.add((i, o, f))
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_state_equals_brute_force(spark, batches):
    rng = random.Random(batches)
    rows = []
    for n in range(1500):
        e, p, v = rng.randrange(20), rng.choice(["a", "b", None]), rng.randrange(3)
        t = None if rng.random() < 0.03 else at(rng.randrange(30))
        i = None if rng.random() < 0.02 else f"{e}{p}{v}"
        e = "none" if i is None else e
        p = None if i is None else p
        rows.append((n, i, rng.choice(["o", None]), rng.choice(["", None, "f", "g"]), f"e{e}", p, str(v), t, t, t if rng.random() < 0.2 and t else None))
    rows += rows[:100]
    df = spark.createDataFrame(rows, CHANGES)
    got = changes.apply_changes(df, batches=batches)
    keys = [tuple(r) for r in got.select("id", "origin", "fragment").collect()]
    assert set(keys) == brute_state(rows) and len(keys) == len(set(keys))


def test_untouched_base_rows_stay(spark):
    row = lambda i, t, d=None, f="": (0, i, "o", f, "e", "p", i, at(t), at(t), None if d is None else at(d))
    base = spark.createDataFrame([row("keep", 0), row("gone", 0), row("f1", 0, f="f")], CHANGES)
    feed = spark.createDataFrame([row("gone", 2, 2), row("new", 1), row("f2", 3, f="f")], CHANGES)
    assert sorted(r["id"] for r in changes.apply_changes(feed, base).collect()) == ["f2", "keep", "new"]
    assert sorted(r["id"] for r in changes.apply_changes(feed.limit(0), base).collect()) == ["f1", "gone", "keep"]
    assert changes.apply_changes(feed.limit(0)).count() == 0
