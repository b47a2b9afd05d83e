import pytest
from pyspark.sql import functions as F

from statelake.plans.query import C, Compiler, G, M, P, Query, QueryError, parse, parse_flat, parse_rql
from statelake.registry import Registry
from statelake.schema import live_view
from tests.helpers import at, statement as s, statements


@pytest.fixture(scope="module")
def live(spark):
    return live_view(statements(
        spark,
        s("1", "jane", "name", "Jane Doe", schema="Person", origin="a"), s("2", "jane", "country", "de", schema="Person", prop_type="country", origin="b"),
        s("3", "bob", "name", "Bob", schema="Person"), s("4", "bob", "name", "Alfred", schema="Person"), s("5", "acme", "name", "Acme", schema="Company", first=5),
        s("6", "acme", "jurisdiction", "de", schema="Company", prop_type="country"), s("7", "doc", "contentHash", "c0", schema="Pages", bucket="pages"), s("8", "folder", "fileName", "x", schema="Folder", bucket="document"),
        s("9", "gone", "name", "Gone", schema="Person", deleted=1),
    )).cache()


def ids(live, q):
    return sorted({r[0] for r in Compiler(Registry(), 16).statements(live, q).select("entity_id").collect()})


CASES = [
    (Query(), ["acme", "bob", "doc", "folder", "jane"]),
    (Query(C(entity_id="jane")), ["jane"]),
    (Query(M(schema="Person")), ["bob", "jane"]),
    (Query(M(schemata="LegalEntity")), ["acme", "bob", "jane"]),
    (Query(M(schemata="Document"), ~M(schema="Folder")), ["doc"]),
    (Query(P(name="Bob")), ["bob"]),
    (Query(P(name="Jane Doe", country="de")), ["jane"]),  # two properties hold on different rows of one entity
    (Query(P(country__null=True)), ["acme", "bob", "doc", "folder"]),
    (Query(P(contentHash__null=False)), ["doc"]),
    (Query(G(countries="de")), ["acme", "jane"]),
    (Query(C(first_seen__gte="2024-01-03")), ["acme"]),
    (Query(M(origin="a") | P(name__startswith="Al")), ["bob", "jane"]),
    (Query(~(M(schema="Person") | M(schema="Company"))), ["doc", "folder"]),
    (Query(P(name__in=["Bob", "Acme"]), M(schema__not_in=["Company"])), ["bob"]),
    (Query(P(name__ilike="%DOE")), ["jane"]),
    (Query(P(name__gt="B"), P(name__lte="C")), ["bob"]),
    (Query(P(name__endswith="me")), ["acme"]),
]


@pytest.mark.parametrize("query, want", CASES)
def test_leaves(live, query, want):
    assert ids(live, query) == want
    assert Compiler(Registry(), 16).count(live, query).first()[0] == len(want)
    assert Query.from_dict(query.to_dict()).to_json() == query.to_json()


def test_whole_entities_and_slices_count_entities(live):
    c = Compiler(Registry())
    assert c.statements(live, Query(P(name="Alfred"))).count() == 2
    ranked = Query(P(name__null=False)).order_by("name")
    assert [r[0] for r in c.entity_ids(live, ranked).collect()] == ["acme", "bob", "jane"]
    assert [r[0] for r in c.entity_ids(live, ranked[1:2]).collect()] == ["bob"]
    assert [r[0] for r in c.entity_ids(live, Query().order_by("name", False)[:2]).collect()] == ["jane", "bob"]
    assert ids(live, Query()[1:3]) == ["bob", "doc"]
    assert c.statements(live, ranked[:1]).count() == 2


def test_order_survives_the_join_and_assembly(spark, root, live):
    from statelake.dataset import Catalog

    c = Compiler(Registry())
    rows = [(r["entity_id"], r["id"]) for r in c.statements(live, Query(P(name__null=False)).order_by("name")).collect()]
    assert rows == [("acme", "5"), ("acme", "6"), ("bob", "3"), ("bob", "4"), ("jane", "1"), ("jane", "2")]
    down = c.statements(live, Query().order_by("country", False).order_by("name")).select("entity_id").collect()
    assert list(dict.fromkeys(r[0] for r in down)) == ["jane", "acme", "bob", "doc", "folder"]
    ds = Catalog(spark, root).dataset("quay", shards=4)
    ds.store.append(statements(spark, *[s(str(i), f"e{i}", "name", name, shard=str(i % 4)) for i, name in enumerate(["Mo", "Al", "Zed", "Bo", "Al", "Kim"])]))
    names = lambda q: [(r["caption"], r["id"]) for r in ds.query(q).collect()]
    assert names(Query().order_by("name")) == [("Al", "e1"), ("Al", "e4"), ("Bo", "e3"), ("Kim", "e5"), ("Mo", "e0"), ("Zed", "e2")]
    assert names(Query().order_by("name", False)[1:3]) == [("Mo", "e0"), ("Kim", "e5")]


def test_an_entity_in_several_buckets_is_seen_in_those_asked_for(spark):
    """A condition on the schema reads its buckets only; one on the id reads all of the entity."""
    both = live_view(statements(spark, s("1", "e", "name", "N", schema="Person"), s("2", "e", "fileName", "f", schema="Pages", bucket="pages")))
    c = Compiler(Registry(), 1)
    assert [r["id"] for r in c.statements(both, Query(M(schema="Person"))).collect()] == ["1"]
    assert sorted(r["id"] for r in c.statements(both, Query(P(name="N"))).collect()) == ["1", "2"]
    assert c.count(both, Query(M(schema="Person"), P(fileName="f"))).first()[0] == 0


def test_grammars(live):
    assert ids(live, parse_flat("filter:schema=Person&filter:group.countries=de")) == ["jane"]
    assert ids(live, parse_flat("filter:name__in=Bob,Acme&sort=-name&limit=1")) == ["bob"]
    assert ids(live, parse_rql("or(eq(schema,Company),eq(entity_id,jane))")) == ["acme", "jane"]
    assert ids(live, parse_rql('and(eq(schema,Person),not(eq(name,"Jane Doe")))')) == ["bob"]
    assert ids(live, parse_rql("in(name,(Bob,Acme)),ne(schema,Company)")) == ["bob"]
    assert ids(live, parse_rql("eq(name,Jane Doe)")) == ["jane"]
    for bad in ("or(eq(schema,Company)", "foo(a,b)", "eq(schema,Company))", "not(eq(a,b),eq(c,d))", "eq"):
        with pytest.raises(QueryError):
            parse_rql(bad)
    with pytest.raises(QueryError):
        parse_flat("schema=Person")
    with pytest.raises(QueryError):
        parse("filter:schema=Person", "eq(schema,Person)")
    assert parse().where_ is None


def test_limits():
    with pytest.raises(QueryError):
        Query.from_dict({"filter": 1})
    with pytest.raises(QueryError):
        Query.from_dict(Query(*[P(name=str(i)) for i in range(21)]).to_dict())
    many = Query(P(name__in=[str(i) for i in range(10_001)]))  # only queries from outside are limited
    with pytest.raises(QueryError):
        Query.from_dict(many.to_dict())
    with pytest.raises(QueryError):
        M(colour="red")
    with pytest.raises(QueryError):
        P(name__near="x")
    with pytest.raises(QueryError):
        Query()[3:1]


def test_partition_prunes(spark, live, root):
    statements(spark, s("1", "jane", shard="4"), s("2", "bob", shard="d", bucket="interval")).write.partitionBy("shard", "bucket").parquet(f"{root}/t")
    stored = live_view(spark.read.schema(statements(spark).schema).parquet(f"{root}/t"))
    plan = Compiler(Registry(), 16).statements(stored, Query(M(schema="Person"), M(entity_id="jane")))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "shard" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters: [" in plan


def test_envelope_lines_hold_whole_entities(spark, tmp_path):
    """Against brute force: every value, caption and date of a changed entity; of a deleted one its id."""
    import json

    from statelake.plans import reference

    late = 310.0  # after reference.SINCE
    log = [
        s("1", "new", "name", 'Jane "J" Doe', schema="Person", first=late), s("2", "new", "name", "Ann", schema="Person", first=1), s("3", "new", "country", "de", schema="Person", prop_type="country", first=2, origin="b"),
        s("4", "new", "id", "sum", schema="Person", first=3), s("5", "old", "name", "Acme", first=1), s("6", "gone", "name", "Gone", first=1), s("6", "gone", "name", "Gone", first=1, last=late, deleted=late), s("7", "back", "name", "Back", first=late),
        s("8", "back", "alias", "B", first=1, last=late, deleted=late),
    ]
    raw = statements(spark, *log)
    raw.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in raw.dtypes]).write.parquet(f"{tmp_path}/statements.parquet")
    spark.createDataFrame([("Person", "name", "name", "string", True)], "schema string, prop string, prop_type string, cell_type string, many boolean").write.parquet(f"{tmp_path}/schema_props.parquet")
    lines = [json.loads(r["value"]) for r in reference.queries()["diff_envelope_lines"](spark, str(tmp_path)).collect()]

    changed = {r["entity_id"] for r in log if r["first_seen"] >= at(305) or (r["deleted_at"] and r["deleted_at"] >= at(305))}
    dead = {r["id"] for r in log if r["deleted_at"]}
    want = {}
    for e in changed:
        live = [r for r in log if r["entity_id"] == e and r["id"] not in dead]
        named = [r for r in live if r["prop"] != "id"]
        if not live:
            want[e] = ("DEL", {"id": e})
            continue
        props = {p: sorted(r["value"] for r in named if r["prop"] == p) for p in {r["prop"] for r in named}}
        stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S")
        body = {
            "id": e, "schema": live[0]["schema"], "caption": props["name"][0], "properties": props, "referents": [], "datasets": ["ds"], "origin": sorted({r["origin"] for r in live}),
            "first_seen": stamp(min(r["first_seen"] for r in named)), "last_seen": stamp(max(r["last_seen"] for r in named)),
        }
        sums = [r["first_seen"] for r in live if r["prop"] == "id"]
        want[e] = ("ADD", body | ({"last_change": stamp(max(sums))} if sums else {}))
    cut = lambda v: v[:19] if isinstance(v, str) else v
    got = {x["entity"]["id"]: (x["op"], {k: cut(v) if k.endswith(("_seen", "_change")) else v for k, v in x["entity"].items()}) for x in lines}
    assert len(lines) == len(got) == 3 and got == want
