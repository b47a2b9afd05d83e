"""The table, the journal, exports and the archive, end to end."""

import gzip
import json
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statelake.dataset import Catalog
from statelake.plans.query import M, P, Query
from statelake.sources import files as fmt
from statelake.sources.archive import Archive
from statelake.sources.paths import Folder
from statelake.sources.store import Conflict, StatementStore
from statelake.sources.tags import Jobs, Tags, Versions
from tests.helpers import at, statement as s, statements

JANE = {"id": "jane.f00d", "schema": "Person", "properties": {"name": ["Jane Doe", "Jane Doe", ""], "country": ["de"], "bogus": ["x"]}}
ACME = {"id": "acme", "schema": "Company", "properties": {"name": ["Acme"]}}
NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


def payloads(spark, *rows):
    return spark.createDataFrame([(r["id"], r["schema"], r["properties"]) for r in rows], "id string, schema string, properties map<string,array<string>>")


def test_store_versions_and_reads(spark, root):
    store = StatementStore(spark, root, 16)
    assert store.version() is None and not store.exists() and store.raw().count() == 0 and store.partitions() == []
    assert store.append(statements(spark, s("a"), s("b", origin="x y"), s("c", shard="1", bucket="pages"))) == 1
    assert store.append(statements(spark, s("a", first=3))) == 2
    assert store.append(statements(spark)) == 2
    assert store.partitions() == [("0", "thing", "ingest"), ("0", "thing", "x y"), ("1", "pages", "ingest")]
    assert store.raw().count() == 4 and store.raw(1).count() == 3
    assert store.live().where("canonical_id = entity_id").count() == 4
    assert store.select_partition("1", "pages").count() == 1
    assert set(store.partition_bytes()) == set(store.partitions())
    plan = store.raw().where("bucket = 'pages'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_store_merge_compact_vacuum(spark, root):
    store = StatementStore(spark, root)
    store.append(statements(spark, s("a", first=0), s("dead", deleted=1, last=1)))
    store.append(statements(spark, s("a", first=3), s("o", origin="other")))
    assert store.needs_merge() and len(store.merge(now=NOW)) == 2
    assert not store.needs_merge() and store.merge(now=NOW) == []
    rows = store.raw().collect()
    assert sorted(r["id"] for r in rows) == ["a", "o"] and next(r["first_seen"] for r in rows if r["id"] == "a") == at(0)
    store.append(statements(spark, s("n", origin="other")))
    assert store.dirty() == [("0", "thing", "other")]
    assert store.compact() == 1 and store.raw().count() == 3 and store.compact() == 0
    assert store.vacuum(timedelta(hours=1)) == 0 and store.vacuum() > 0 and store.raw().count() == 3
    store.append(statements(spark, s("o", origin="other", last=9, deleted=9), s("n", origin="other", last=9, deleted=9)))
    store.merge(now=NOW)
    assert ("0", "thing", "other") not in store.partitions(), "a partition of expired tombstones disappears"
    store.destroy()
    assert not store.exists()


def test_store_guards(spark, root, monkeypatch):
    store = StatementStore(spark, root)
    with pytest.raises(Exception, match="without value"):
        store.append(statements(spark, s(value=None)))
    with pytest.raises(ValueError):
        store.append(statements(spark, s(origin="../x")))
    store.append(statements(spark, s()))
    with pytest.raises(Conflict):
        store._commit(0, [], [], "late")
    monkeypatch.setattr(StatementStore, "WAIT", 0.001)
    monkeypatch.setattr(StatementStore, "TRIES", 2)
    store.folder.create(".LOCK", "")
    for blocked in (store.vacuum, store.merge, store.compact, lambda: store.append(statements(spark, s("x")))):
        with pytest.raises(Conflict, match="locked"):
            blocked()
    assert store.folder.names("appending") == [], "a refused append withdraws its marker"
    assert store.unlock() and not store.unlock()
    store.folder.create("appending/dead", "")
    for blocked in (store.vacuum, store.merge, lambda: store.compact(), store.destroy):
        with pytest.raises(Conflict, match="append is under way"):
            blocked()
    assert not store.folder.exists(".LOCK"), "maintenance that gives up frees its lock"
    assert store.unlock() and store.raw().count() == 1


def test_vacuum_spares_an_append_under_way(spark, root, monkeypatch):
    """Files that are written but not committed yet outlive a vacuum, a merge and a compaction, and no row is lost."""
    import threading

    store, other = StatementStore(spark, root), StatementStore(spark, root)
    store.append(statements(spark, s("a"), s("b", origin="x")))
    store.append(statements(spark, s("a", first=2)))
    written, go = threading.Event(), threading.Event()
    write = StatementStore._write

    def slow(self, rows, operation):
        found = write(self, rows, operation)
        if operation == "append":
            written.set()
            assert go.wait(60)
        return found

    monkeypatch.setattr(StatementStore, "_write", slow)
    monkeypatch.setattr(StatementStore, "WAIT", 0.01)
    late = threading.Thread(target=lambda: other.append(statements(spark, s("c"), s("d", origin="x"))))
    late.start()
    assert written.wait(60)
    monkeypatch.setattr(StatementStore, "TRIES", 3)
    for maintain in (store.vacuum, lambda: store.merge(now=NOW), store.compact):
        with pytest.raises(Conflict, match="append is under way"):
            maintain()
    monkeypatch.setattr(StatementStore, "TRIES", 200)
    done = []
    cleaning = threading.Thread(target=lambda: done.append(store.vacuum()))
    cleaning.start()
    go.set()
    late.join(60)
    cleaning.join(60)
    assert done == [0] and sorted(r["id"] for r in store.raw().collect()) == ["a", "a", "b", "c", "d"]
    store.merge(now=NOW)
    store.vacuum()
    assert sorted(r["id"] for r in store.raw().collect()) == ["a", "b", "c", "d"] and not store.needs_merge()


def test_of_two_committers_one_wins_each_version(spark, root):
    from concurrent.futures import ThreadPoolExecutor

    store = StatementStore(spark, root)
    store.ensure()
    entry = lambda n: {"path": f"p{n}", "shard": "0", "bucket": "b", "origin": "o", "size": 1, "by": "append"}
    folders = [Folder(spark, root) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda f: f.create("log/race", "x" * 100_000), folders)) == 1
    assert len(store.folder.read("log/race")) == 100_000 and store.folder.names("log") == ["race", "v000000000000.json"]

    def commit(n):
        while True:
            try:
                return store._commit(store.version(), [entry(n)], [], "append")
            except Conflict:
                pass

    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(commit, range(40)))
    assert sorted(versions) == list(range(1, 41)) and len(store.files()) == 40 and len(store.files(7)) == 7
    assert [n for n in store.folder.names("log") if n.startswith("s")] == ["s000000000016.json", "s000000000032.json"]
    store._commit(40, [], [entry(3)], "compact")
    assert len(store.files()) == 39 and len(store.files(40)) == 40


def test_compaction_copies_blocks_and_keeps_partitions_dirty(spark, root):
    store = StatementStore(spark, root, 2)
    for day in range(4):
        store.append(statements(spark, s("a", first=day), s("b", origin="x y:z", first=day), s("c", shard="1", bucket="pages", first=day)))
    before = sorted(map(tuple, store.raw().collect()), key=repr)
    assert len(store.files()) == 12 and store.compact() == 9 and len(store.files()) == 3
    assert sorted(map(tuple, store.raw().collect()), key=repr) == before
    assert store.partitions() == [("0", "thing", "ingest"), ("0", "thing", "x y:z"), ("1", "pages", "ingest")] and len(store.dirty()) == 3
    assert [(k, df.count()) for k, df in store.by_partition()] == [(("0", "thing"), 8), (("1", "pages"), 4)]
    store.merge(now=NOW)
    store.append(statements(spark, s("d")))
    assert store.compact() == 1 and store.dirty() == [("0", "thing", "ingest")], "a merged file joined with an appended one is no merged one"
    assert store.vacuum() > 0 and store.raw().count() == 4


def test_flushes_exclude_each_other(spark, root):
    ds = Catalog(spark, root).dataset("quay")
    ds.journal.add(statements(spark, s("a")))
    ds.journal.folder.create(".FLUSH", "")
    with pytest.raises(Conflict, match="another flush"):
        ds.flush()
    assert ds.journal.count() == 1 and ds.unlock() and not ds.unlock()
    assert ds.flush() == 1 and ds.journal.is_empty()


def test_dataset_life(spark, root):
    ds = Catalog(spark, root).dataset("quay", shards=16, title="Quay")
    ds.write_entities(payloads(spark, JANE, ACME), "ingest")
    assert ds.journal.count() == 5 and not ds.journal.is_empty() and ds.count() == 0
    assert ds.journal.entity("jane").count() == 3
    assert ds.flush() == 5 and ds.journal.is_empty() and ds.flush() == 0 and ds.store.version() == 1
    (jane,) = ds.get("jane").collect()
    assert jane["caption"] == "Jane Doe" and jane["properties"] == {"name": ["Jane Doe"], "country": ["de"]} and jane["schema"] == "Person" and jane["last_change"] is not None
    assert ds.count(Query(P(name="Acme"))) == 1 and ds.query(Query(M(schema="Person"))).count() == 1
    assert ds.sql("SELECT count(*) AS n FROM statement").first()["n"] == 5
    made = ds.make()
    assert all(made.values()) and not any(ds.make().values()), "a second run finds everything fresh"
    assert spark.read.text(f"{root}/quay/exports/entities.json").count() == 2
    assert json.loads(ds.folder.read("statistics.json"))["entity_count"] == 2
    first = spark.read.text(f"{root}/quay/exports/diff/entities/*").collect()
    assert sorted(json.loads(r[0])["op"] for r in first) == ["ADD", "ADD"]
    assert ds.delete_entity("acme") == 2 and ds.delete_entity("acme") == 0 and ds.delete_entity("nobody") == 0
    ds.flush()
    with pytest.raises(RuntimeError):
        ds.export_diff()
    assert ds.optimize()["merged"] == 1 and ds.optimize() == {"merged": 0, "compacted": 0, "vacuumed": 0}
    assert ds.count() == 1 and ds.store.raw().where("deleted_at is not null").count() == 2
    folder = ds.export_diff()
    assert [json.loads(r[0]) for r in spark.read.text(folder).collect()] == [{"op": "DEL", "entity": {"id": "acme"}}]
    assert ds.export_diff() is None
    assert ds.jobs.latest("optimize").status == "done"
    with pytest.raises(ValueError):
        ds.export("nothing")


def test_unknown_schema_fails(spark, root):
    ds = Catalog(spark, root).dataset("quay")
    with pytest.raises(Exception, match="unknown schema"):
        ds.write_entities(payloads(spark, JANE | {"schema": "Unicorn"}))


def test_import_parity(spark, root, tmp_path):
    """Entities, their statements as CSV, and a re-import of those give the same table."""
    (tmp_path / "in.json").write_text("".join(json.dumps(e | {"last_change": "2024-01-02T00:00:00", "origin": "src"}) + "\n" for e in (JANE, ACME)))
    with gzip.open(tmp_path / "in.json.gz", "wt") as f:
        f.write((tmp_path / "in.json").read_text())
    catalog = Catalog(spark, root)
    a, b, c = (catalog.dataset(n, shards=4) for n in ("one", "two", "three"))
    a.import_entities(f"{tmp_path}/in.json")
    b.import_entities(f"{tmp_path}/in.json.gz")
    fmt.write_csv(a.store.live(), f"{root}/csv")
    c.import_statements(f"{root}/csv")
    look = lambda d: sorted(tuple(r) for r in d.store.live().where("prop <> 'id'").select("entity_id", "prop", "prop_type", "value", "origin", "shard", "first_seen").collect())
    assert look(a) == look(b) == look(c) and len(look(a)) == 3
    assert a.store.live().select("id").where("prop <> 'id'").collect() != c.store.live().select("id").where("prop <> 'id'").collect(), "ids belong to their dataset"


def test_at_least_once_drain(spark, root):
    ds = Catalog(spark, root).dataset("quay")
    rows = statements(spark, s("a"), s("b"))
    ds.journal.add(rows)
    ds.flush()
    ds.journal.add(rows)
    ds.journal.add_ipc(fmt.to_ipc(rows.toArrow()))
    ds.flush()
    assert ds.store.raw().count() == 6
    ds.store.merge(now=NOW)
    assert ds.store.raw().count() == 2
    ds.journal.add(rows)
    ds.journal.clear()
    assert ds.flush() == 0


def test_fragment_re_emission_and_override(spark, root):
    from statelake.operators.assemble import override

    base = statements(spark, s("a", value="old"), s("b"))
    out = override(base, statements(spark, s("a", value="new"), s("c")))
    assert sorted((r["id"], r["value"]) for r in out.collect()) == [("a", "new"), ("b", "v"), ("c", "v")]


def test_catalog(spark, root):
    catalog = Catalog(spark, root)
    assert catalog.names() == [] and not catalog.exists("quay")
    with pytest.raises(KeyError):
        catalog.config("quay")
    catalog.update("quay", title="A", shards=4)
    assert catalog.update("quay", title="B").title == "B" and catalog.config("quay").shards == 4 and catalog.names() == ["quay"]
    with pytest.raises(ValueError):
        catalog.update("quay", shards=8)
    with pytest.raises(ValueError):
        catalog.dataset("../x")
    assert len(Versions(Folder(spark, f"{root}/quay")).list("config.yml")) == 2


def test_tags_versions_jobs(spark, root):
    tags = Tags(Folder(spark, f"{root}/t"))
    assert not tags.is_latest("x", ["y"])
    tags.touch("x")
    assert not tags.is_latest("x", ["y"]) and not tags.is_latest("x", [])
    tags.touch("y", NOW)
    assert tags.is_latest("x", ["y", "z"])
    tags.touch("x", NOW)
    assert not tags.is_latest("x", ["y"])
    with pytest.raises(ValueError):
        tags.touch("x", datetime(2024, 1, 1))
    versions = Versions(Folder(spark, f"{root}/v"))
    assert versions.make("a.json", "1") and versions.make("a.json", "1") is None and versions.make("a.json", "2")
    assert len(versions.list("a.json")) == 2
    jobs = Jobs(Folder(spark, f"{root}/j"))
    with pytest.raises(ZeroDivisionError):
        jobs.run("bad", lambda job: 1 / 0)
    assert jobs.latest("bad").status == "failed" and "ZeroDivisionError" in jobs.latest("bad").exc and jobs.latest("none") is None
    job, result = jobs.run("good", lambda job: job.count("rows", 3) or 5)
    assert result == 5 and job.exc is None and jobs.latest("good").counters == {"rows": 3}


def test_archive(spark, root, tmp_path):
    archive = Archive(spark, root, "quay")
    assert archive.files().count() == 0
    record = archive.store("a/b.txt", b"hello", "crawl", "text/plain", author="J")
    assert record["id"].startswith("file-") and archive.exists(record["checksum"])
    archive.store("c.txt", b"hello")
    assert archive.files().count() == 2 and archive.blobs().count() == 1 and len(archive.records(record["checksum"])) == 2
    assert bytes(archive.blobs([record["checksum"]]).first()["content"]) == b"hello"
    archive.put_text(record["checksum"], "text", "ocr")
    assert archive.text(record["checksum"]) == "text" and archive.text(record["checksum"], "ocr") == "text" and archive.text(record["checksum"], "none") is None
    with pytest.raises(ValueError):
        archive.put_text(record["checksum"], "x", "../up")
    with pytest.raises(ValueError):
        archive.text("nope")
    source = tmp_path / "source" / "sub"
    source.mkdir(parents=True)
    for name, body in {"x.txt": "hello", "y.txt": "new", "z.tmp": "tmp"}.items():
        (source / name).write_text(body)
    got = archive.crawl(f"file://{tmp_path}/source", exclude_glob="*.tmp", policy="skip-checksum")
    assert [(r["key"], r["size"], r["mimetype"]) for r in got.collect()] == [("sub/y.txt", 3, "text/plain")]
    assert archive.crawl(f"file://{tmp_path}/source", glob="*.txt").count() == 1 and archive.crawl(f"file://{tmp_path}/source", prefix="other").count() == 0
    before = {r["id"]: r["created_at"] for r in archive.files().collect()}
    again = archive.crawl(f"file://{tmp_path}/source", glob="*.txt", policy="overwrite")
    assert again.count() == 2 and {r["id"]: r["created_at"] for r in archive.files().collect()} == before, "a record keeps the time it was made"
    assert archive.blobs().count() == 2
    with pytest.raises(ValueError):
        archive.crawl(f"file://{tmp_path}/source", policy="sometimes")
    assert sorted(r[0] for r in archive.download(f"{root}/out").collect()) == ["a/b.txt", "c.txt", "sub/x.txt", "sub/y.txt"] and archive.download(f"{root}/out").count() == 0
    assert (tmp_path / "out" / "sub" / "y.txt").read_text() == "new"
    assert b"".join(archive.stream(record["checksum"], 2)) == b"hello" and open(archive.local_path(record["checksum"]), "rb").read() == b"hello"
    archive.delete(record)
    assert archive.exists(record["checksum"])


def test_codecs(spark):
    for codec in (None, "gz", "zst"):
        assert fmt.unwrap(fmt.wrap(b"abc" * 100, codec), codec) == b"abc" * 100
    assert fmt.wrap(b"x", "gz") == fmt.wrap(b"x", "gz")
    with pytest.raises(ValueError):
        fmt.wrap(b"", "rar")
    table = pa.table({"a": [1, 2]})
    assert fmt.from_ipc(spark, fmt.to_ipc(table)).agg(F.sum("a")).first()[0] == 3


def test_stream_operators(spark, root):
    from statelake.streaming.journal import first_deliveries, windowed_counts

    rows = [(at(0), "a", 1), (at(0.01), "a", 1), (at(0.02), "b", 2), (at(1), "a", 3)]
    spark.createDataFrame(rows, "t timestamp, k string, i int").coalesce(1).write.parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema("t timestamp, k string, i int").parquet(f"{root}/in")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert run(windowed_counts(stream(), "t", "k"), "windows_", "append").agg(F.sum("n")).first()[0] == 3  # the last window stays open
    assert run(first_deliveries(stream(), "t", ["i"]), "firsts_", "append").count() == 3


def test_ndjson_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from statelake.sources.http import NdjsonSource, parse_lines

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"\n".join(json.dumps({"id": f"{self.path}{i}"}).encode() for i in range(3)) + b"\n\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(NdjsonSource)
    base = f"http://127.0.0.1:{server.server_port}"
    rows = parse_lines(spark.read.format("ndjson").option("urls", f"{base}/a {base}/b").load(), "id string").collect()
    server.shutdown()
    assert sorted(r["id"] for r in rows) == ["/a0", "/a1", "/a2", "/b0", "/b1", "/b2"]


def test_documents_export_and_source(spark, root):
    """Files become folder and document entities; the listing has their paths and can be read back."""
    from statelake.operators.documents import file_entities, folder_entities
    from statelake.sources.files import read_documents

    ds = Catalog(spark, root).dataset("quay", public_url_prefix="https://data.example.org/${dataset}")
    for path in ("top/sub/a.txt", "top/b.txt", "c.txt"):
        ds.archive.store(path, path.encode(), "crawl", "text/plain")
    files = ds.archive.files().withColumn("extra", F.to_json("extra"))
    ds.write_entities(folder_entities(files), "crawl", bulk=True)
    ds.write_entities(file_entities(files), bulk=True)
    assert ds.export("documents")
    rows = {r["name"]: r for r in read_documents(spark, f"{root}/quay/exports/documents.csv").collect()}
    assert {k: r["path"] for k, r in rows.items()} == {"a.txt": "top/sub", "b.txt": "top", "c.txt": None}
    assert rows["a.txt"]["size"] == 13 and rows["a.txt"]["mimetype"] == "text/plain"
    assert rows["a.txt"]["public_url"].startswith("https://data.example.org/quay/") and rows["a.txt"]["id"].startswith("file-")
    assert ds.count(Query(M(schema="Folder"))) == 2


@pytest.mark.parametrize("codec", [None, "gz", "zst"])
def test_exports_in_every_compression(spark, root, tmp_path, codec):
    """Exports are read back as they were, imported again, and streamed as one plain text with one heading."""
    import io

    from statelake.sources.files import read_documents

    ds = Catalog(spark, root).dataset("quay", shards=4, compression=codec)
    odd = {"id": "odd", "schema": "Person", "properties": {"name": ['a "b", c', "line\nbreak", " blank "], "country": ["de"]}}
    ds.write_entities(payloads(spark, JANE, ACME, odd), "ingest", bulk=True)
    file = {"id": "f1", "schema": "PlainText", "properties": {"fileName": ['x, "y".txt'], "contentHash": ["c0"], "fileSize": ["7"]}}
    ds.write_entities(payloads(spark, file), "ingest", bulk=True)
    assert ds.export("statements") and ds.export("entities") and ds.export("documents")
    suffix = {None: "", "gz": ".gz", "zst": ".zst"}[codec]
    names = Folder(spark, f"{root}/quay/exports/statements.csv").names()
    assert names and all(n.startswith("part-") and n.endswith(suffix) for n in names)
    live = sorted((r["entity_id"], r["prop"], r["value"]) for r in ds.store.live().collect())
    assert sorted((r["entity_id"], r["prop"], r["value"]) for r in ds.exported_statements().collect()) == live
    assert {r["id"]: sorted(r["properties"].get("name", [])) for r in ds.exported_entities().collect()} == {r["id"]: sorted(r["properties"].get("name", [])) for r in ds.query().collect()}
    assert [(r["name"], r["size"]) for r in read_documents(spark, f"{root}/quay/exports/documents.csv").collect()] == [('x, "y".txt', 7)]
    copy = Catalog(spark, root).dataset("copy", shards=2)
    copy.import_statements(f"{root}/quay/exports/statements.csv")
    assert sorted((r["entity_id"], r["prop"], r["value"]) for r in copy.store.live().collect()) == live
    again = Catalog(spark, root).dataset("again", shards=2)
    again.import_entities(f"{root}/quay/exports/entities.json")
    assert again.count() == 4
    sink = io.BytesIO()
    assert ds.stream_export("statements", sink) == len(sink.getvalue())
    import csv

    rows = list(csv.DictReader(io.StringIO(sink.getvalue().decode())))
    assert sorted((r["entity_id"], r["prop"], r["value"]) for r in rows) == live and [r["entity_id"] for r in rows] == sorted(r["entity_id"] for r in rows)
    with pytest.raises(ValueError):
        ds.stream_export("index", sink)
    with pytest.raises(FileNotFoundError):
        copy.stream_export("entities", sink)
    with pytest.raises(ValueError):
        Catalog(spark, root).dataset("bad", compression="rar")


def test_files_of_a_merge_are_sorted(spark, root):
    from statelake.operators.merge import SORT

    store = StatementStore(spark, root)
    store.append(statements(spark, *[s(f"s{i % 17}", f"e{i * 7 % 11}", ["name", "alias"][i % 2], str(i), first=i % 5, origin=["a", "b"][i % 3 == 0]) for i in range(200)]))
    store.merge(now=NOW)
    for f in store.files():
        rows = spark.read.parquet(f"{root}/data/{f['path']}").coalesce(1).collect()
        keys = [tuple(r[c] for c in SORT[:-1]) for r in rows]
        assert keys == sorted(keys) and len(keys) > 10


def test_statements_are_written_as_they_are(spark, root):
    ds = Catalog(spark, root).dataset("quay", shards=16)
    ds.write_statements(statements(spark, s("a", "jane", shard="wrong")))
    assert ds.journal.count() == 1 and ds.flush() == 1
    ds.write_statements(statements(spark, s("b", "jane", shard="wrong")), bulk=True)
    assert {(r["id"], r["shard"]) for r in ds.store.raw().collect()} == {("a", "4"), ("b", "4")}


def test_local_addresses(spark, tmp_path):
    """Blanks in a path, with and without a scheme; tasks and the driver mean the same folder."""
    from statelake.sources.blobs import Store, resolve

    here = f"{tmp_path}/a b"
    assert {resolve(u)[1] for u in (here, f"file:{here}", f"file://{here}")} == {here}
    for number, root in enumerate((here, f"file://{here}")):
        store = StatementStore(spark, f"{root}/t{number}")
        for day in range(2):
            store.append(statements(spark, s("a", first=day)))
        assert store.compact() == 1 and store.raw().count() == 2
        Store(root).put(f"x{number}", b"1")
    assert sorted(p.name for p in (tmp_path / "a b").iterdir()) == ["t0", "t1", "x0", "x1"]
