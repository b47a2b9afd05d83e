"""Every query with a SQL statement gives that statement's rows; every other one runs."""

import os

import pytest

from statelake.plans import problems, reference
from tests.oracle import DATA, assert_equal

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

QUERIES = reference.queries() | problems.queries()
SQL = reference.oracle_sql() | problems.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert_equal(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_queries_and_sql_match():
    assert set(SQL) <= set(QUERIES)


def test_physical_compaction_takes_exactly_the_files_found(spark):
    """What the listing says is to be consolidated is what the block copy consumed, with the rows the table holds."""
    report = problems.compaction(spark, DATA)
    found = {r[0] for r in problems.p5_found(spark, DATA).collect()}
    taken = {r["file_no"]: r["rows"] for r in report.collect()}
    assert set(taken) == found
    held = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/statements.parquet").groupBy("file_no").count().collect()}
    assert taken == {n: held[n] for n in found}
    assert report.select("bin").distinct().count() < len(found) / 2
