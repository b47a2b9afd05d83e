"""One form for texts that look the same.

DuckDB runs inside each Arrow partition and maps, in one embedded statement,
compatibility forms, blanks, invisible characters and look-alike letters, with
canonical composition in between. Look-alikes map to Latin; composed letters of
other scripts map to what their base letter and accents look like, so that
composed and decomposed spellings agree.

Kept apart: case, accents, digits, words, line breaks, punctuation, the number
of blanks. Windows and old Mac line ends look like line breaks and become those.

Edge cases: a null text has a null form; an empty text has an empty one; forms
without a visible character never match anything; texts are processed whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԛԝԁӏАВЕКМНОРСТХІЈЅԚԜӀҮ", "aeopcyxijshqwdlABEKMHOPCTXIJSQWIY"))
GREEK = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovcjABEZHIKMNOPTYXCJ"))
ARMENIAN = dict(zip("օսհոցՕՍ", "ouhngOU"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN

# Hyphens drawn like the hyphen-minus.
HYPHENS = {"‐": "-", "‑": "-"}

COMPATIBILITY_RANGES = [(0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x2160, 0x2180)]
COMPOSED_RANGES = [(0x0370, 0x0530), (0x1F00, 0x2000)]
INVISIBLE = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"


def _blanks() -> dict[str, str]:
    return {"\t": " ", "⠀": " "} | {c: " " for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs"}


def _seen(text: str) -> str:
    """What a canonically decomposed text looks like."""
    return unicodedata.normalize("NFC", "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFD", text)))


@lru_cache(maxsize=1)
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """``(one to one, one to several)`` character mappings, all but the plain look-alikes derived from Unicode's own tables."""
    table = _blanks() | HYPHENS | LOOKALIKE
    for lo, hi in COMPATIBILITY_RANGES:
        for c in map(chr, range(lo, hi)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and unicodedata.category(c) != "Cn":
                table[c] = _seen(plain)
    for lo, hi in COMPOSED_RANGES:
        for c in map(chr, range(lo, hi)):
            if unicodedata.category(c) != "Cn" and (look := _seen(c)) != unicodedata.normalize("NFC", c):
                table.setdefault(c, look)
    single = {c: t for c, t in table.items() if len(t) == 1 and c != t}
    return single, {c: t for c, t in table.items() if len(t) > 1}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The form of ``column`` as a DuckDB expression.

    Invisible characters go first, since they may stand between a letter and its
    accent; letters are mapped before and after composition, since either
    spelling of an accented look-alike may occur.
    """
    single, several = mappings()
    translate = lambda e: f"translate({e}, {_quote(''.join(single))}, {_quote(''.join(single.values()))})"
    expr = f"regexp_replace({column}, {_quote(INVISIBLE)}, '', 'g')"
    expr = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    expr = translate(expr)
    rare = "".join(several)
    chained = "t"
    for c, t in several.items():
        chained = f"replace({chained}, {_quote(c)}, {_quote(t)})"
    # the chain of replacements runs only over texts that hold one of its characters
    expr = f"list_transform([{expr}], lambda t: CASE WHEN regexp_matches(t, {_quote('[' + rare + ']')}) THEN {chained} ELSE t END)[1]"
    return translate(f"nfc_normalize({expr})")


VISIBLE = r"[^\s]"


def _run(columns: str):
    """A partition function that selects ``columns`` (DuckDB SQL over ``t(key, text, form)``)."""
    sql = f"SELECT {columns} FROM (SELECT k, text, {form_sql('text')} AS form FROM batch)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # texts come in small portions, so there is nothing to spill, and no folder to spill to
        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        for batch in batches:
            for part in _portions(batch):
                con.register("batch", pa.Table.from_batches([part]).rename_columns(["k", "text"]))
                result = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from result.to_batches()
        con.close()

    return run


def _portions(batch: pa.RecordBatch, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` texts and about ``size`` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def canonical_form(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, form`` for every row."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(_run(f'k AS "{key}", form'), f"`{key}` {kind}, form string")


def form_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, form_hash, text_hash`` (128 bits each) of every text with a visible character; texts do not leave the worker."""
    kind = documents.schema[key].dataType.simpleString()
    keep = f"regexp_matches(form, {_quote(VISIBLE)})"
    digests = f"k AS \"{key}\", CASE WHEN {keep} THEN md5(form) END AS form_hash, CASE WHEN {keep} THEN md5(text) END AS text_hash"
    made = documents.select(F.col(key), F.col(text)).mapInArrow(_run(digests), f"`{key}` {kind}, form_hash string, text_hash string")
    return made.where("form_hash is not null").select(key, F.unhex("form_hash").alias("form_hash"), F.unhex("text_hash").alias("text_hash"))


def same_look_pairs(digests: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>_a, <key>_b`` of rows with one form and different texts. ``digests`` is read twice, so it should be staged.

    Forms with one text only (every text without a variant, however often it is repeated) are dropped by an aggregate with
    map-side combine before anything is joined. Texts are paired as classes first, so repeats of one
    text are never held against each other.
    """
    varied = digests.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("form_hash")
    rows = digests.join(varied, "form_hash", "left_semi")
    texts = rows.select("form_hash", "text_hash").distinct()
    one, other = texts.withColumnRenamed("text_hash", "text_a"), texts.withColumnRenamed("text_hash", "text_b")
    variants = one.join(other, "form_hash").where("text_a < text_b").select("text_a", "text_b")
    first = variants.join(rows.select(F.col("text_hash").alias("text_a"), F.col(key).alias("a")), "text_a")
    both = first.join(rows.select(F.col("text_hash").alias("text_b"), F.col(key).alias("b")), "text_b")
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))


def same_look_classes(digests: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, class_id`` of every row that has a partner in :func:`same_look_pairs`: membership instead of pairs, linear in the rows.

    A class is a form that several texts have; it is named by its smallest key.
    """
    groups = digests.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.min(key).alias("class_id")).where("lo <> hi")
    return digests.join(groups.select("form_hash", "class_id"), "form_hash").select(key, "class_id")
