import hashlib

import pytest
from pyspark.sql import functions as F

from statelake.functions import ids, values
from statelake.operators.cells import parse_amount, parse_count, parse_date
from statelake.registry import Registry


def one(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_shards(spark):
    assert ids.shard_key("jane", 8) == "4" and {ids.shard_key("jane", 16), ids.shard_key("bob", 16)} == {"4", "d"}
    assert [ids.shard_hex_width(n) for n in (1, 16, 32, 4096)] == [1, 1, 2, 3]
    names = ["jane", "bob", "", "ü", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "id string")
    ids.register_sql_functions(spark)
    df.createOrReplaceTempView("names_")
    for shards in (1, 8, 16, 32, 4096):
        want = {n: ids.shard_key(n, shards) for n in names}
        assert {r[0]: r[1] for r in df.select("id", ids.entity_shard(F.col("id"), shards)).collect()} == want
        assert {r[0]: r[1] for r in spark.sql(f"SELECT id, entity_shard(id, {shards}) FROM names_").collect()} == want


def test_file_and_folder_ids(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    foo = "folder-" + sha("foo")
    assert foo.startswith("folder-2c26b46b") and foo.endswith("66e7ae")
    assert one(spark, ids.folder_chain(F.lit("foo/bar"))) == [foo, "folder-" + sha(foo + "bar")]
    assert one(spark, ids.folder_chain(F.lit(""))) == []
    assert one(spark, ids.file_id(F.lit("a.txt"), F.lit("c"))) == "file-" + sha("a.txtc")
    assert one(spark, ids.blob_key(F.lit("A" * 64))) is None
    assert one(spark, ids.blob_key(F.lit("ab" * 32))) == "archive/ab/ab/ab/" + "ab" * 32 + "/blob"


def test_strip_namespace(spark):
    for text, want in {"a.b.c": "a.b", "jane.f00d": "jane", "jane": "jane", "": None, "ä b": None}.items():
        assert one(spark, ids.strip_namespace(F.lit(text))) == want


def test_statement_ids_differ_by_each_part(spark):
    def make(d="d", e="e", p="p", v="v", ext=False, lang=None):
        return one(spark, ids.statement_id(F.lit(d), F.lit(e), F.lit(p), F.lit(v), F.lit(ext), F.lit(lang).cast("string")))

    assert len({make(), make(d="x"), make(e="x"), make(p="x"), make(v="x"), make(ext=True), make(lang="de")}) == 7
    assert make(v=None) is None
    # parts never run into each other
    assert make(v="c.ext") != make(v="c", ext=True) and make(v="c.@en") != make(v="c", lang="en") and make(v="c|1|0") != make(v="c", ext=True)
    assert make(e="a.b", p="c") != make(e="a", p="b.c") and make(d="d|1", e="e") != make(d="d", e="1|e") and make(lang="") != make()
    ids.register_sql_functions(spark)
    assert spark.sql("SELECT statement_id('d', 'e', 'p', 'v', true, 'de') AS x").first()["x"] == make(ext=True, lang="de")
    assert spark.sql("SELECT statement_id('d', 'e', 'p', 'v', false, NULL) AS x").first()["x"] == make()


def test_names():
    for bad in ("", " ", None, "a/b", "a\\b", "..", "x..y", "a\n", "x" * 256):
        with pytest.raises(ValueError):
            values.validate_origin(bad)
    assert values.validate_origin("upload-01 ä") == "upload-01 ä"
    for bad in ("catalog", "default", "ü", "a b", "-x", "a-b", "Quay"):
        with pytest.raises(ValueError):
            values.validate_dataset_name(bad)
    with pytest.raises(ValueError):
        values.validate_checksum("AB" * 32)
    assert values.parse_byte_size("8GB") == 8 * 10**9 and values.parse_byte_size("512 MiB") == 512 << 20 and values.parse_byte_size("1.5k") == 1500 and values.parse_byte_size("2PB") == 2 * 10**15 and values.parse_byte_size("1 pib") == 1 << 50 and values.parse_byte_size(7) == 7


def test_mime(spark):
    assert one(spark, values.pick_mime(F.array(F.lit("application/octet-stream"), F.lit("Text/HTML; charset=x")))) == "text/html"
    assert one(spark, values.pick_mime(F.array(F.lit(None).cast("string")))) == "application/octet-stream"
    assert one(spark, values.mime_schema(F.lit(None).cast("string"))) == "Document"
    for name, want in {"a.PDF": "application/pdf", "b.tar.csv": "text/csv", "none": None, "x.": None, ".html": "text/html", "y.unheardof": None}.items():
        assert one(spark, values.guess_mime(F.lit(name))) == want
    assert one(spark, values.pick_mime(F.array(F.lit("application/octet-stream")), F.lit("text/csv"))) == "text/csv"
    for mime, schema in {"text/xml": "HyperText", "Text/RTF; x": "PlainText", "image/vnd.djvu": "Image", "image/vnd.adobe.photoshop": "Image", "application/oebps-package+xml": "Email"}.items():
        assert one(spark, values.mime_schema(F.lit(mime))) == schema


def test_registry():
    r = Registry()
    assert r.common("Company", "LegalEntity") == "Company" and r.common("Person", "Company") == "LegalEntity"
    assert r.common("Payment", "Person") is None
    assert "Folder" in r.descendants("Document") and r.bucket("Membership") == "interval" and r.bucket("Person") == "thing" and r.bucket("Pages") == "pages"


DATES = {
    "2014-05-13": "2014-05-13", "\t1931-06-15 ": "1931-06-15", "13.5.2014": "2014-05-13", "01.02.1948": "1948-02-01", "19300116": "1930-01-16", "1930/05/22": "1930-05-22",
    "Apr 19, 1936": "1936-04-19", "1 December 2008": "2008-12-01", "8 May 1969": "1969-05-08", "2020-06-01T20:32:00": "2020-06-01", "2020-06-01 20:32:00": "2020-06-01", "２０２０-06-01": "2020-06-01",
    "1960-02-30": None, "0000-00-00": None, "before 1951": None, "2021-09": None, "2019": None, "May 1951": None, "unknown": None, "": None, "31.2.2001": None, "13 Foo 2014": None, "2020-13-01": None, "2020-01/02": None,
    "2020-00-10": None, "12/05/2010": None, "29.2.2000": "2000-02-29", "29.2.1900": None,
}
AMOUNTS = {
    "10.00": "10.00", "9,05": "9.05", "1,049,355.53": "1049355.53", "9.999,99": "9999.99", "EUR 1162.06": "1162.06", "€132,772.00": "132772.00", "6,01 €": "6.01", "9 999 999.99": "9999999.99",
    "1 292 534,78": "1292534.78", "167'008.00": "167008.00", "+12.87": "12.87", "3105.9": "3105.90", "2184833": "2184833.00", "-5": "-5.00", "1,234": "1234.00", "0.50": "0.50", "007.10": "7.10",
    "12..5": None, "1,2,3.4.5": None, ".": None, "-": None, "EUR": None, "NaN": None, "see annex": None, "1,234,56": None, "12.3456": None, "": None, "1 23": None, "10 %": None,
}
COUNTS = {
    "00083": "83", "10,040": "10040", "10156.0": "10156", "10'354": "10354", "10 733": "10733", "1073\n": "1073", "+1066": "1066", "0": "0", "000": "0", "12,00": "12", "1.234": "1234", "3 000 000": "3000000", "-7": "-7",
    "12/a": None, "0x": None, "~": None, "12.50": None, "12.5": None, "null": None, "many": None, "": None, "1,23,456": None,
}


@pytest.mark.parametrize("parse, cases", [(parse_date, DATES), (parse_amount, AMOUNTS), (parse_count, COUNTS)])
def test_cells(spark, parse, cases):
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "v string")
    got = {r[0]: r[1] for r in df.select("v", parse(F.col("v")).cast("string")).collect()}
    assert got == {**cases, None: None}


def test_every_file_has_its_chain_of_folders(spark, tmp_path):
    """All spellings of a directory give one chain, files at the root have none, and each folder of a chain is listed with its parent."""
    from statelake.plans import reference

    def chain(*names):
        out = []
        for n in names:
            out.append("folder-" + hashlib.sha256(((out[-1] if out else "") + n).encode()).hexdigest())
        return out

    keys = {"top/sub /a.txt": ["top", "sub "], "/top/sub /b.txt": ["top", "sub "], "./top//sub /./c.txt": ["top", "sub "], "top\\sub \\d.txt": ["top", "sub "], "other/e.txt": ["other"], "f.txt": [], "./g.txt": []}
    rows = [(k, f"sum{i}", None if i % 2 else "named", i, None, "crawl", None) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "key string, checksum string, name string, size bigint, mimetype string, origin string, extra string").write.parquet(f"{tmp_path}/files.parquet")
    got = {r["id"]: r for r in reference.queries()["file_entities"](spark, str(tmp_path)).collect()}
    assert len(got) == len(keys)
    for (key, names), row in zip(keys.items(), rows):
        r = got["file-" + hashlib.sha256((key + row[1]).encode()).hexdigest()]
        want = chain(*names)
        assert r["chain"] == " ".join(want) and r["parent"] == (want[-1] if want else None)
        assert (r["schema"], r["contentHash"], r["fileSize"], r["fileName"]) == ("Document", row[1], str(row[3]), row[2] or key[-5:])
    folders = {tuple(r) for r in reference.queries()["folder_entities"](spark, str(tmp_path)).select("id", "name", "parent").collect()}
    top, sub = chain("top", "sub ")
    assert folders == {(top, "top", None), (sub, "sub ", top), (*chain("other"), "other", None)}


def test_public_urls_take_each_rows_dataset(spark, tmp_path):
    from statelake.plans import reference

    files = spark.createDataFrame([(1, "quay", "a/b.txt", "b.txt", "c1"), (2, "port", "d.txt", "d.txt", "c2"), (3, None, "e.txt", "e.txt", "c3")], "row_no bigint, dataset string, key string, name string, checksum string")
    files.write.parquet(f"{tmp_path}/some/files.parquet")
    files.limit(0).write.parquet(f"{tmp_path}/none/files.parquet")
    run = reference.queries()["public_urls"]
    got = {r["row_no"]: (r["url"], r["relative"]) for r in run(spark, f"{tmp_path}/some").collect()}
    assert got == {1: ("https://data.example.org/quay/c1", "a/b.txt"), 2: ("https://data.example.org/port/c2", "d.txt"), 3: (None, "e.txt")}
    assert run(spark, f"{tmp_path}/none").count() == 0
