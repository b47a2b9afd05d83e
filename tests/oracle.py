"""Run a query and its DuckDB statement over the smallest test data and compare rows."""

import glob
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect(config={"threads": 4})
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    return tuple(map(_plain, value)) if isinstance(value, list) else str(value) if hasattr(value, "isoformat") else value


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((repr(tuple(_plain(r[n]) for n in names)) for r in table.to_pylist()))


def assert_equal(spark, query, sql):
    got, want = rows(query(spark, DATA).toArrow()), rows(connect().sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
