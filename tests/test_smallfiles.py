import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from statelake.operators import smallfiles
from statelake.operators.parquet_blocks import BlockCopier, IncompatibleFiles, join_images, footer_of

ACTIONS = "action_no bigint, table_version bigint, action string, file_no bigint, shard string, bucket string, origin string, num_rows bigint, size_bytes bigint"


def image(table, **options):
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, **options)
    return sink.getvalue().to_pybytes()


def random_table(rng, rows):
    return pa.table({
        "s": pa.array([rng.choice([None, "", "ü" * rng.randrange(50), "x" * 2000]) for _ in range(rows)], pa.string()),
        "n": pa.array([rng.choice([None, rng.randrange(-(2**60), 2**60)]) for _ in range(rows)], pa.int64()),
        "d": pa.array([rng.random() for _ in range(rows)], pa.float64()),
        "b": pa.array([rng.choice([True, False, None]) for _ in range(rows)], pa.bool_()),
        "t": pa.array([rng.randrange(10**15) for _ in range(rows)], pa.timestamp("us")),
        "l": pa.array([[1, 2], None, []][:rows] + [[3]] * max(0, rows - 3), pa.list_(pa.int32())),
    })


@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"compression": "none", "use_dictionary": False}, {"row_group_size": 3}, {"version": "1.0", "data_page_version": "2.0"}, {"write_page_index": True, "write_page_checksum": True}])
def test_round_trip(options):
    rng = random.Random(3)
    tables = [random_table(rng, n) for n in (1, 7, 0, 100, 5)]
    images = [image(t, **options) for t in tables]
    joined = join_images(images)
    assert pq.read_table(pa.BufferReader(joined)).equals(pa.concat_tables(tables))
    meta = pq.read_metadata(pa.BufferReader(joined))
    again = join_images([joined, images[0]])
    assert pq.read_table(pa.BufferReader(again)).num_rows == meta.num_rows + 1
    if options.get("use_dictionary") is False:  # compatible chunks become one
        assert meta.num_row_groups == 1
        return
    assert meta.num_row_groups == sum(pq.read_metadata(pa.BufferReader(i)).num_row_groups for i in images)
    stats = pq.read_metadata(pa.BufferReader(joined)).row_group(0).column(1).statistics
    assert stats is not None and stats.null_count == tables[0].column("n").null_count


def test_compatible_chunks_are_merged_and_others_kept():
    """Pages without a dictionary share a chunk; a codec, a dictionary or a large chunk in between starts a new row group; order stays."""
    rng = random.Random(4)
    plain = {"use_dictionary": False, "write_statistics": False, "store_schema": False}
    parts = [(random_table(rng, 5), plain), (random_table(rng, 9), plain), (random_table(rng, 4), {"store_schema": False}), (random_table(rng, 6), plain | {"compression": "zstd"}), (random_table(rng, 2), plain)]
    copier = BlockCopier()
    for table, options in parts:
        assert copier.add(image(table, **options)) == table.num_rows
    joined = copier.finish()
    meta = pq.read_metadata(pa.BufferReader(joined))
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [14, 4, 6, 2]
    assert copier.blocks == 5 and copier.rows == meta.num_rows == 26
    assert pq.read_table(pa.BufferReader(joined)).equals(pa.concat_tables([t for t, _ in parts]))
    assert len(joined) < sum(len(image(t, **o)) for t, o in parts)


def test_merged_files_are_read_by_spark(spark, tmp_path):
    plain = {"use_dictionary": False, "write_statistics": False, "store_schema": False, "compression": "snappy"}
    images = [image(pa.table({"n": pa.array(range(i, i + 3), pa.int64()), "s": [str(i), None, "ü" * i]}), **plain) for i in range(200)]
    (tmp_path / "m.parquet").write_bytes(join_images(images))
    df = spark.read.parquet(f"{tmp_path}/m.parquet")
    assert df.count() == 600 and df.where("n >= 200").count() == 3 and df.agg({"n": "sum"}).first()[0] == sum(3 * i + 3 for i in range(200))
    assert df.where("s is null").count() == 200


def test_many_row_groups_and_bytes_are_copied():
    t = pa.table({"a": ["x"] * 3})
    part = image(t)
    joined = join_images([part] * 40)
    assert pq.read_table(pa.BufferReader(joined)).num_rows == 120
    start = part.index(b"PAR1") + 4
    assert joined.count(part[start : start + 30]) == 40


def test_incompatible_inputs_are_refused():
    copier = BlockCopier()
    copier.add(image(pa.table({"a": [1]})))
    with pytest.raises(IncompatibleFiles):
        copier.add(image(pa.table({"a": ["x"]})))
    with pytest.raises(IncompatibleFiles):
        join_images([])
    with pytest.raises(IncompatibleFiles):
        footer_of(b"PAR1 rubbish")


def test_plan(spark):
    rows = [
        (1, 1, "add", 1, "0", "t", "o", 5, 100), (1, 1, "add", 1, "0", "t", "o", 5, 100), (2, 1, "add", 2, "0", "t", "o", None, 100), (3, 1, "add", 3, "0", "t", "o", 5, 16384),
        (4, 1, "add", 4, "0", "t", "p", 5, 100), (5, 1, "add", 5, "0", "t", "o", 5, 100), (6, 2, "remove", 5, "0", "t", "o", 5, 100), (7, 3, "add", 6, None, None, "o", 5, 1), (8, 3, "add", 7, None, None, "o", 5, 1),
        (9, 1, "remove", 8, "0", "t", "o", 5, 1), (10, 2, "add", 8, "0", "t", "o", 5, 1), (11, 2, "add", 9, "0", "t", "o", 5, 1), (12, 2, "remove", 9, "0", "t", "o", 5, 1), (13, 1, "add", 10, "0", "t", "o", 5, None), (14, 1, "add", None, "0", "t", "o", 5, 1),
    ]
    log = spark.createDataFrame(rows, ACTIONS)
    plan = smallfiles.plan(log).collect()
    assert sorted(r["file_no"] for r in plan) == [1, 2, 6, 7, 8]
    assert len({r["bin"] for r in plan}) == 2
    assert smallfiles.plan(log.limit(0)).count() == 0
    assert len({r["bin"] for r in smallfiles.plan(log, max_files=1).collect()}) > 2


def test_files_become_fewer_and_rows_stay(spark, tmp_path):
    rows, actions, paths = [], [], []
    for n in range(60):
        table = pa.table({"id": [f"{n}-{i}" for i in range(1 + n % 7)]})
        path = f"{tmp_path}/in/{n}.parquet"
        (tmp_path / "in").mkdir(exist_ok=True)
        pq.write_table(table, path)
        rows += table.column("id").to_pylist()
        actions.append((n, 1, "add", n, str(n % 3), "t", "o", table.num_rows if n % 5 else None, 500))
        paths.append((n, f"{n}.parquet"))
    planned = smallfiles.plan(spark.createDataFrame(actions, ACTIONS), max_files=8)
    files = planned.join(spark.createDataFrame(paths, "file_no bigint, path string"), "file_no")
    report = smallfiles.compact_files(files, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 4).collect()
    assert sorted(r["file_no"] for r in report) == list(range(60))
    outs = {r["out_path"] for r in report}
    assert 3 <= len(outs) < 20
    assert sorted(r["id"] for r in spark.read.parquet(*[f"{tmp_path}/out/{o}" for o in outs]).collect()) == sorted(rows)
    again = smallfiles.compact_files(files, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 2).collect()  # a repeated run overwrites its own files
    assert {r["out_path"] for r in again} == outs


def test_wrong_row_count_stops_the_run(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), f"{tmp_path}/1.parquet")
    df = spark.createDataFrame([("b", 1, 3, "1.parquet")], "bin string, file_no bigint, num_rows bigint, path string")
    with pytest.raises(Exception, match="the log says 3 rows"):
        smallfiles.compact_files(df, f"file://{tmp_path}", f"file://{tmp_path}/out", 1).collect()


def test_files_of_several_schemas_share_a_bin_but_no_file(spark, tmp_path):
    tables = [pa.table({"a": [1]}), pa.table({"a": ["x", "y"]}), pa.table({"a": [2, 3, 4]})]
    for i, t in enumerate(tables):
        pq.write_table(t, f"{tmp_path}/{i}.parquet")
    df = spark.createDataFrame([("b", i, t.num_rows, f"{i}.parquet") for i, t in enumerate(tables)], "bin string, file_no bigint, num_rows bigint, path string")
    report = smallfiles.compact_files(df, f"file://{tmp_path}", f"file://{tmp_path}/out", 2).collect()
    outs = {r["file_no"]: r["out_path"] for r in report}
    assert outs[0] == outs[2] != outs[1] and sorted(r["rows"] for r in report) == [1, 2, 3]
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/{outs[0]}").collect()) == [1, 2, 3, 4]


def test_files_formed_from_rows(spark, tmp_path):
    """Files over several batches, without rows, not planned, with clashing column names; every row exactly as often as before."""
    from statelake.session import Scratch

    rng = random.Random(1)
    group = lambda n: (str(n % 3), None if n % 3 else "t", "o")
    rows = [(n, *group(n), rng.choice([None, "", "x" * 3000, f"v{i}"]), i, True) for n in range(40) for i in range(rng.choice([1, 2, 300]))]
    rows += rows[:3]
    table = spark.createDataFrame(rows, "file_no int, shard string, bucket string, origin string, bin string, num_rows int, here boolean")
    log = [(n, 1, "add", n, *group(n), None, 20_000 if n in (5, 6) else 100) for n in range(41)] + [(99, 2, "remove", 7, *group(7), None, 100)]
    actions = spark.createDataFrame(log, ACTIONS)
    compact = lambda a, r, name: smallfiles.compact_rows(a, r, f"file://{tmp_path}/{name}", 2, Scratch(spark, "test"), max_files=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        report = compact(actions, table, "out").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {n: sum(r[0] == n for r in rows) for n in range(41) if n not in (5, 6, 7)}
    assert {r["file_no"]: r["rows"] for r in report} == held and held[40] == 0
    assert len({r["bin"] for r in report}) > 3
    copied = spark.read.parquet(*{f"{tmp_path}/out/{r['out_path']}" for r in report})
    assert copied.columns == table.columns[1:]
    assert sorted(map(tuple, copied.collect()), key=repr) == sorted([r[1:] for r in rows if r[0] in held], key=repr)
    assert compact(actions.limit(0), table, "none").count() == 0
    astray = spark.createDataFrame([(1, "9", None, "o", "", 0, True)], table.schema)
    with pytest.raises(Exception, match="not all rows were copied of file 1"):
        compact(actions, table.union(astray), "astray").collect()


def test_files_found_are_those_that_were_copied(spark, tmp_path):
    """A file that does not hold the rows its log entry names fails the query: the listing alone is not the job."""
    from pyspark.sql import functions as F

    from statelake.plans import problems
    from tests.oracle import DATA

    spark.read.parquet(f"{DATA}/statements.parquet").write.parquet(f"{tmp_path}/statements.parquet")
    log = spark.read.parquet(f"{DATA}/statement_files.parquet")
    log.withColumn("num_rows", F.col("num_rows") + 1).write.parquet(f"{tmp_path}/statement_files.parquet")
    with pytest.raises(Exception, match="the log says"):
        problems.p5_found(spark, str(tmp_path)).collect()
