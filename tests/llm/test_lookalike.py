import unicodedata
from itertools import combinations

from statelake.llm.lookalike import LOOKALIKE, canonical_form, form_digests, same_look_classes, same_look_pairs

SAME = [
    ["Invoice 12", "Ｉｎｖｏｉｃｅ １２", "Inv​oice 12", "Іnvоісе 12", "Invoice 12", "﻿Invoice　12‎"],
    ["café", "café", "ｃａｆé", "cafе́", "ca­fe⁠́"],
    ["office", "oﬃce", "of‍fice"],
    ["naïve", "naїve", "naїve", "naïve"],
    ["A-1", "A‐1", "A‑1", "Α1-".replace("1-", "-1")],
    ["Ό x".replace("Ό", "Ó"), "Ό x", "Ό x"],
    ["line\nbreak", "line\r\nbreak"],
    ["50 K", "50 K"],
    ["key; x", "key; x"],
    ["dl ouhng vcj", "ԁӏ օսհոց νϲϳ"],
]
DIFFERENT = ["rose", "Rose", "rosé", "ros e", "rose.", "rose;", "rose,", "r0se", "rose\nrose", "rose rose", "rose  rose", "rose-rose", "rose—rose", "ßose", "ж", "й", "и", "ё", "е́", "l1", "ll", "II"]


def brute_form(text):
    """An independent version: decompose, map, compose."""
    drop = {chr(c) for c in (0x200B, 0x200C, 0x200D, 0x200E, 0x2060, 0xFEFF, 0xAD, 0x34F, 0xFE0E, 0xFE0F)}
    wide = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF5F), *range(0xFB00, 0xFB07)]}
    blank = {c: " " for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs"} | {9: " ", 0x2010: "-", 0x2011: "-"}
    out = "".join(c for c in unicodedata.normalize("NFD", text) if c not in drop).translate(wide | blank | {ord(a): b for a, b in LOOKALIKE.items()})
    return unicodedata.normalize("NFC", out).replace("\r\n", "\n").replace("\r", "\n")


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


def test_same_look_has_one_form(spark):
    flat = [(g, t) for g, group in enumerate(SAME) for t in group]
    forms = {r["doc_id"]: r["form"] for r in canonical_form(texts(spark, [t for _, t in flat])).collect()}
    for i, (g, t) in enumerate(flat):
        assert forms[i] == forms[next(j for j, (h, _) in enumerate(flat) if h == g)], ascii(t)
        assert forms[i] == brute_form(t), ascii(t)


def test_different_look_stays_different(spark):
    forms = [r["form"] for r in canonical_form(texts(spark, DIFFERENT)).collect()]
    assert len(set(forms)) == len(DIFFERENT)


def test_form_is_stable(spark):
    values = [t for g in SAME for t in g] + DIFFERENT
    once = canonical_form(texts(spark, values))
    forms = {r["doc_id"]: r["form"] for r in once.collect()}
    again = {r["doc_id"]: r["form"] for r in canonical_form(once, text="form").collect()}
    assert forms == again


def test_pairs_and_edges(spark):
    values = [None, "", " ", "​", "\n", "abc", "abc", "аbc", "ab​c", "xyz", "xyz", "long " * 40000, "long " * 40000]
    df = texts(spark, values)
    got = sorted(tuple(r) for r in same_look_pairs(form_digests(df)).collect())
    seen = [(i, t) for i, t in enumerate(values) if t and brute_form(t).strip()]
    assert got == [(i, j) for (i, a), (j, b) in combinations(seen, 2) if a != b and brute_form(a) == brute_form(b)]
    assert same_look_pairs(form_digests(df.limit(0))).count() == 0
    classes = {r["doc_id"]: r["class_id"] for r in same_look_classes(form_digests(df)).collect()}
    assert set(classes) == {i for pair in got for i in pair} and all(classes[a] == classes[b] for a, b in got)
    assert classes == {i: min(j for j in classes if brute_form(values[j]) == brute_form(values[i])) for i in classes}
    assert same_look_classes(form_digests(df.limit(0))).count() == 0


def test_portions_hold_every_text():
    import pyarrow as pa

    from statelake.llm.lookalike import _portions

    texts = ["x" * n if n % 5 else None for n in range(300)] + ["", "y" * 50_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    parts = list(_portions(batch, 20, 1000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert max(p.num_rows for p in parts) <= 20 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1000 for p in parts)
