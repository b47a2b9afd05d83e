import os

import pytest

from statelake.llm.queries import oracle_sql, queries
from tests.oracle import DATA, assert_equal

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    assert_equal(spark, queries()[name], oracle_sql()[name])


def test_ids_equal_an_independent_tokenizer(spark):
    from tests.llm.test_tokenize import peer

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries()["p8_ids"](spark, DATA).collect()}
    assert got == dict(zip(texts, peer()(list(texts.values()))))


def test_every_profile_holds_every_document(spark):
    rows = queries()["p9_packed"](spark, DATA).collect()
    want = {r["doc_id"]: len(r["ids"]) for r in queries()["p8_ids"](spark, DATA).collect()}
    for profile in {r["profile"] for r in rows}:
        got = {}
        for r in rows:
            if r["profile"] == profile:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        assert got == {k: n for k, n in want.items() if n}
    fill = {r["profile"]: r for r in queries()["p9_fill"](spark, DATA).collect()}
    assert all(r["fullest"] <= r["capacity"] for r in fill.values())
