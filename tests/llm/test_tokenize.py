import random

import pytest

from statelake.llm.tokenize import decode_ids, encoder, token_counts, token_ids, vocabulary

ODD = [None, "", " ", "  \n\t ", "<|endoftext|> is text", "a" * 20000, "naïve ﬁ 👍🏽 日本語", "\x00\x01", "I'll we've 'S", "1234567 12", "　ｘ　", "don't  stop", "word " * 3000, "é", "Ġ ▁ <unk>"]


def peer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def random_texts(n=300):
    rng = random.Random(7)
    alphabet = "aeiou tnsr  ,.'\n\t0123éüßжωΩ日👍‍️" + chr(0x301) + chr(0x200B)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_equals_an_independent_tokenizer_and_round_trips():
    texts = ODD + random_texts()
    e = encoder(vocabulary())
    ids = e.encode_batch(texts)
    assert ids == peer()(texts)
    assert ids == e.encode_batch(texts), "cached pre-tokens give the same ids"
    assert [e.decode(i) for i in ids] == [t or "" for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_other_vocabularies_round_trip(name):
    e = encoder(vocabulary(name))
    texts = random_texts(50)
    assert [e.decode(i) for i in e.encode_batch(texts)] == texts


def test_whole_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = {r["doc_id"]: r["ids"] for r in token_ids(df).collect()}
    assert [out[i] for i in range(len(ODD))] == peer()(ODD) and out[0] == [] and out[1] == []
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {k: len(v) for k, v in out.items()}
    assert {r["doc_id"]: r["text"] for r in decode_ids(token_ids(df)).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert token_ids(df.limit(0)).count() == 0
