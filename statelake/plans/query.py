"""The entity query language: leaves, boolean algebra, two text grammars, and its compiler.

A leaf selects *entities*: those with at least one live row that satisfies it.
Leaves combine per entity, and the result is every live row of the entities
selected. Compiled, all leaves become one aggregate over one scan: a flag per
leaf and entity, combined on the map side.

A condition on the schema that must hold reads only the buckets of that schema,
and one on the id only its shard. The shard holds the whole entity. An entity
with rows in several buckets is seen, and given, as its rows in the buckets
asked for.

Sorted results are in order of the sort values (the smallest of each entity),
then of entity and statement id; sorted entities stay in that order when they
are assembled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelake.functions.ids import shard_key
from statelake.registry import GROUPS, Registry

# Limits of queries that come from outside.
MAX_LEAVES = 20
MAX_VALUES = 10_000

META = {"entity_id", "canonical_id", "schema", "schemata", "origin", "dataset"}
COLUMNS = {"id", "entity_id", "dataset", "bucket", "origin", "source", "schema", "prop", "prop_type", "value", "original_value", "lang", "first_seen", "last_seen", "fragment", "deleted_at", "shard"}
COMPARATORS = {"eq", "not", "in", "not_in", "gt", "gte", "lt", "lte", "like", "ilike", "startswith", "endswith", "null"}


class QueryError(ValueError):
    """A query that cannot be understood or exceeds the limits."""


class Expr:
    def __and__(self, other: "Expr") -> "Expr":
        return Node("and", [self, other])

    def __or__(self, other: "Expr") -> "Expr":
        return Node("or", [self, other])

    def __invert__(self) -> "Expr":
        return Node("not", [self])

    def leaves(self) -> list["Leaf"]:
        raise NotImplementedError


@dataclass(eq=True)
class Leaf(Expr):
    kind: str  # meta, prop, column or group
    name: str
    op: str
    value: object

    def __post_init__(self):
        if self.op not in COMPARATORS:
            raise QueryError(f"unknown comparator {self.op!r}")
        if self.kind == "meta" and self.name not in META or self.kind == "column" and self.name not in COLUMNS or self.kind == "group" and self.name not in GROUPS:
            raise QueryError(f"unknown {self.kind} field {self.name!r}")
        if self.op in ("in", "not_in"):
            self.value = list(self.value) if isinstance(self.value, (list, tuple, set)) else str(self.value).split(",")

    def leaves(self) -> list["Leaf"]:
        return [self]


@dataclass(eq=True)
class Node(Expr):
    op: str
    parts: list[Expr]

    def leaves(self) -> list[Leaf]:
        return [leaf for p in self.parts for leaf in p.leaves()]


def _leaves(kind: str, terms: dict) -> Expr:
    found = [Leaf(kind, *_split(k), v) for k, v in terms.items()]
    if not found:
        raise QueryError("a leaf needs a condition")
    return reduce(lambda a, b: a & b, found)


def _split(key: str) -> tuple[str, str]:
    name, _, op = key.partition("__")
    return name, op or "eq"


def M(**terms) -> Expr:
    """Meta fields: ``M(schema="Person")``, ``M(schemata="Document")``."""
    return _leaves("meta", terms)


def P(**terms) -> Expr:
    """Properties: ``P(name="Jane Doe")``, ``P(contentHash__null=False)``."""
    return _leaves("prop", terms)


def C(**terms) -> Expr:
    """Statement columns: ``C(first_seen__gte=...)``."""
    return _leaves("column", terms)


def G(**terms) -> Expr:
    """Groups of properties by type: ``G(countries="de")``."""
    return _leaves("group", terms)


@dataclass
class Query:
    where_: Expr | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)
    start: int = 0
    stop: int | None = None

    def __init__(self, *parts: Expr, sort=None, start=0, stop=None):
        self.where_ = reduce(lambda a, b: a & b, parts) if parts else None
        self.sort, self.start, self.stop = list(sort or []), start, stop

    def where(self, *parts: Expr) -> "Query":
        q = Query(*([self.where_] if self.where_ else []), *parts, sort=self.sort, start=self.start, stop=self.stop)
        return q

    def order_by(self, prop: str, ascending: bool = True) -> "Query":
        return Query(*([self.where_] if self.where_ else []), sort=[*self.sort, (prop, ascending)], start=self.start, stop=self.stop)

    def __getitem__(self, part: slice) -> "Query":
        if not isinstance(part, slice) or part.step not in (None, 1) or (part.start or 0) < 0 or (part.stop is not None and part.stop < (part.start or 0)):
            raise QueryError("only plain slices of entities are possible")
        return Query(*([self.where_] if self.where_ else []), sort=self.sort, start=part.start or 0, stop=part.stop)

    # wire form

    def to_dict(self) -> dict:
        def dump(e: Expr):
            return {"kind": e.kind, "name": e.name, "op": e.op, "value": e.value} if isinstance(e, Leaf) else {"op": e.op, "parts": [dump(p) for p in e.parts]}

        return {"where": dump(self.where_) if self.where_ else None, "sort": [list(s) for s in self.sort], "start": self.start, "stop": self.stop}

    @classmethod
    def from_dict(cls, body: dict) -> "Query":
        if unknown := set(body) - {"where", "sort", "start", "stop"}:
            raise QueryError(f"unknown keys: {', '.join(sorted(unknown))}")

        def load(d: dict) -> Expr:
            if "parts" in d:
                if d["op"] not in ("and", "or", "not"):
                    raise QueryError(f"unknown operator {d['op']!r}")
                return Node(d["op"], [load(p) for p in d["parts"]])
            return Leaf(d["kind"], d["name"], d.get("op", "eq"), d.get("value"))

        q = cls(*([load(body["where"])] if body.get("where") else []), sort=[tuple(s) for s in body.get("sort") or []], start=body.get("start") or 0, stop=body.get("stop"))
        return q.check()

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def check(self) -> "Query":
        """Enforce the limits of outside queries."""
        if self.where_ and len(self.where_.leaves()) > MAX_LEAVES:
            raise QueryError(f"more than {MAX_LEAVES} conditions")
        if self.where_ and any(isinstance(leaf.value, list) and len(leaf.value) > MAX_VALUES for leaf in self.where_.leaves()):
            raise QueryError(f"more than {MAX_VALUES} values")
        return self


# ---- text grammars


def parse_flat(text: str) -> Query:
    """``filter:schema=Person&filter:group.countries=de&sort=name&limit=10``; repeated fields are alternatives of ``in``."""
    parts, sort, start, limit = [], [], 0, None
    for key, value in parse_qsl(text, keep_blank_values=True):
        if key.startswith("filter:"):
            parts.append(_named(key[7:], value))
        elif key == "sort":
            sort += [(s.lstrip("-"), not s.startswith("-")) for s in value.split(",") if s]
        elif key == "offset":
            start = int(value)
        elif key == "limit":
            limit = int(value)
        else:
            raise QueryError(f"unknown key {key!r}")
    return Query(*parts, sort=sort, start=start, stop=None if limit is None else start + limit).check()


def _named(field_: str, value) -> Leaf:
    name, op = _split(field_)
    if op == "null":
        value = str(value).lower() in ("1", "true", "yes")
    for prefix, kind in (("group.", "group"), ("column.", "column"), ("properties.", "prop"), ("prop.", "prop")):
        if name.startswith(prefix):
            return Leaf(kind, name[len(prefix) :], op, value)
    return Leaf("meta" if name in META else "prop", name, op, value)


_TOKEN = re.compile(r'\s*(?:([A-Za-z_][\w.]*)\s*(\()|([(),])|"((?:[^"\\]|\\.)*)"|([^\s(),"]+(?:\s+[^\s(),"]+)*))')


def parse_rql(text: str) -> Query:
    """``or(eq(schema,Company),and(in(country,(de,fr)),not(null(name))))``, by recursive descent."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"cannot read the query at {text[at:at + 20]!r}")
        call, _, mark, quoted, bare = m.groups()
        tokens.append(("call", call.lower()) if call else ("mark", mark) if mark else ("text", re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else bare))
        at = m.end()
    state = {"i": 0}

    def take(kind: str | None = None, value: str | None = None):
        if state["i"] >= len(tokens):
            raise QueryError("the query ends too early")
        token = tokens[state["i"]]
        if kind and token[0] != kind or value and token[1] != value:
            raise QueryError(f"unexpected {token[1]!r}")
        state["i"] += 1
        return token[1]

    def peek():
        return tokens[state["i"]] if state["i"] < len(tokens) else (None, None)

    def values() -> list[str]:
        out = []
        if peek() == ("mark", "("):
            take()
            while peek() != ("mark", ")"):
                out.append(take("text"))
                if peek() == ("mark", ","):
                    take()
            take("mark", ")")
            return out
        out.append(take("text"))
        while peek() == ("mark", ","):
            take()
            out.append(take("text"))
        return out

    def expr() -> Expr:
        name = take("call")
        if name in ("and", "or", "not"):
            parts = [expr()]
            while peek() == ("mark", ","):
                take()
                parts.append(expr())
            take("mark", ")")
            if name == "not" and len(parts) != 1:
                raise QueryError("not() takes one condition")
            return Node(name, parts)
        op = {"ne": "not", "ge": "gte", "le": "lte", "out": "not_in"}.get(name, name)
        if op not in COMPARATORS:
            raise QueryError(f"unknown operator {name!r}")
        field_ = take("text")
        value: object = True
        if peek() == ("mark", ","):
            take()
            found = values()
            value = found if op in ("in", "not_in") else found[0]
        take("mark", ")")
        return _named(f"{field_}__{op}", value)

    parts = [expr()]
    while peek() == ("mark", ","):
        take()
        parts.append(expr())
    if state["i"] != len(tokens):
        raise QueryError(f"unexpected {peek()[1]!r}")
    return Query(*parts).check()


def parse(flat: str | None = None, rql: str | None = None) -> Query:
    if flat and rql:
        raise QueryError("give either a flat query or RQL, not both")
    return parse_flat(flat) if flat else parse_rql(rql) if rql else Query()


# ---- compiler


def _compare(column: Column, op: str, value) -> Column:
    if op == "eq":
        return column == F.lit(value)
    if op == "not":
        return column != F.lit(value)
    if op == "in":
        return column.isin(value)
    if op == "not_in":
        return ~column.isin(value)
    if op in ("gt", "gte", "lt", "lte"):
        other = F.lit(value)
        return {"gt": column > other, "gte": column >= other, "lt": column < other, "lte": column <= other}[op]
    if op == "like":
        return column.like(str(value))
    if op == "ilike":
        return column.ilike(str(value))
    if op == "startswith":
        return column.startswith(str(value))
    if op == "endswith":
        return column.endswith(str(value))
    raise QueryError(f"{op} does not compare")


@dataclass
class Compiler:
    registry: Registry = field(default_factory=Registry)
    shards: int | None = None  # known only for tables that were written with it

    def predicate(self, leaf: Leaf) -> tuple[Column, bool]:
        """A row predicate, and whether the leaf holds if *no* row satisfies it."""
        if leaf.kind in ("prop", "group"):
            row = F.col("prop") == leaf.name if leaf.kind == "prop" else F.col("prop_type") == GROUPS[leaf.name]
            if leaf.op == "null":
                return row & F.col("value").isNotNull(), bool(leaf.value)
            return row & _compare(F.col("value"), leaf.op, leaf.value), False
        name = "entity_id" if leaf.name == "canonical_id" else leaf.name
        if name == "schemata":
            names = leaf.value if isinstance(leaf.value, list) else [leaf.value]
            below = sorted({d for n in names for d in self.registry.descendants(str(n))})
            return F.col("schema").isin(below) if leaf.op in ("eq", "in") else ~F.col("schema").isin(below), False
        if leaf.op == "null":
            return F.col(name).isNull() if leaf.value else F.col(name).isNotNull(), False
        value = leaf.value
        column = F.col(name)
        if name in ("first_seen", "last_seen", "deleted_at"):
            value = str(value)
            column = column.cast("timestamp")
            return _compare(column, leaf.op, F.lit(value).cast("timestamp") if leaf.op not in ("in", "not_in") else leaf.value), False
        return _compare(column, leaf.op, value), False

    def prunes(self, expr: Expr | None) -> Column | None:
        """Partition predicates implied by the query: schema to bucket, id to shard. Only from conditions that must all hold."""
        if expr is None:
            return None
        out = []
        queue = [expr]
        while queue:
            e = queue.pop()
            if isinstance(e, Node):
                queue += e.parts if e.op == "and" else []
                continue
            if e.kind == "meta" and e.op in ("eq", "in"):
                values = e.value if isinstance(e.value, list) else [e.value]
                if e.name == "schema":
                    out.append(F.col("bucket").isin(sorted({self.registry.bucket(v) for v in values})))
                elif e.name == "schemata":
                    out.append(F.col("bucket").isin(sorted({self.registry.bucket(d) for v in values for d in self.registry.descendants(v)})))
                elif e.name in ("entity_id", "canonical_id") and self.shards:
                    out.append(F.col("shard").isin(sorted({shard_key(v, self.shards) for v in values})))
        return reduce(lambda a, b: a & b, out) if out else None

    def _combine(self, expr: Expr, flags: list[tuple[Leaf, Column]]) -> Column:
        if isinstance(expr, Leaf):
            return next(c for l, c in flags if l is expr)
        parts = [self._combine(p, flags) for p in expr.parts]
        if expr.op == "not":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if expr.op == "and" else (lambda a, b: a | b), parts)

    def entity_ids(self, live: DataFrame, query: Query) -> DataFrame:
        """``entity_id`` of the entities selected, sorted and sliced if the query says so."""
        return self._selected(live, query).select("entity_id")

    def _selected(self, live: DataFrame, query: Query) -> DataFrame:
        """``entity_id`` and the sort values ``__s0`` … of the entities selected."""
        if query.where_ is None and not query.sort:
            return self._slice(live.select("entity_id").distinct(), query)
        leaves = query.where_.leaves() if query.where_ else []
        predicates = [self.predicate(l) for l in leaves]
        if query.where_ is not None and isinstance(query.where_, Leaf) and not predicates[0][1] and not query.sort:
            # a single condition needs no flags, so it reaches the scan
            return self._slice(live.where(predicates[0][0]).select("entity_id").distinct(), query)
        flags = [F.max(p.cast("int")).alias(f"f{i}") for i, (p, _) in enumerate(predicates)]
        keys = [F.min(F.when(F.col("prop") == prop, F.col("value"))).alias(f"__s{i}") for i, (prop, _) in enumerate(query.sort)]
        held = live.groupBy("entity_id").agg(*flags, *keys)
        named = [(l, (F.coalesce(F.col(f"f{i}"), F.lit(0)) == (0 if absent else 1))) for i, (l, (_, absent)) in enumerate(zip(leaves, predicates))]
        ids = held.where(self._combine(query.where_, named)) if query.where_ is not None else held
        return self._slice(ids.select("entity_id", *[f"__s{i}" for i in range(len(query.sort))]), query)

    @staticmethod
    def _order(columns: list[Column], query: Query) -> list[Column]:
        return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, (_, up) in zip(columns, query.sort)]

    def _slice(self, ids: DataFrame, query: Query) -> DataFrame:
        if query.sort or query.start or query.stop is not None:
            ids = ids.orderBy(*self._order([F.col(f"__s{i}") for i in range(len(query.sort))], query), "entity_id")
            if query.start:
                ids = ids.offset(query.start)
            if query.stop is not None:
                ids = ids.limit(query.stop - query.start)
        return ids

    def pruned(self, live: DataFrame, query: Query) -> DataFrame:
        extra = self.prunes(query.where_)
        return live.where(extra) if extra is not None else live

    def statements(self, live: DataFrame, query: Query) -> DataFrame:
        """All live rows of the entities selected, in order if the query sorts. Slices count entities, not rows."""
        live = self.pruned(live, query)
        if query.where_ is None and not query.sort and not query.start and query.stop is None:
            return live
        if not query.sort:
            return live.join(self.entity_ids(live, query), "entity_id", "left_semi")
        rows = live.join(self._selected(live, query), "entity_id")  # an entity is selected once
        order = self._order([F.col(f"__s{i}") for i in range(len(query.sort))], query)
        return rows.orderBy(*order, "entity_id", "id", "origin", "fragment").select(live.columns)

    def in_order(self, entities: DataFrame, query: Query) -> DataFrame:
        """Assembled entities in the order of the query: what :meth:`statements` sorts by is the smallest value of each property."""
        if not query.sort:
            return entities
        return entities.orderBy(*self._order([F.array_min(F.col("properties")[prop]) for prop, _ in query.sort], query), "id")

    def count(self, live: DataFrame, query: Query) -> DataFrame:
        return self.entity_ids(self.pruned(live, query), query).agg(F.count(F.lit(1)).alias("entities"))
