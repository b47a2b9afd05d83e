"""Entity types: their inheritance, properties, captions and buckets.

The lattice, caption orders and property types below are this project's own
seed; only the type names are given by the data. ``Registry.from_props`` adds
the properties of a ``schema_props`` table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARENTS: dict[str, list[str]] = {
    "Thing": [],
    "Interval": [],
    "LegalEntity": ["Thing"],
    "Person": ["LegalEntity"],
    "Organization": ["LegalEntity"],
    "Company": ["Organization"],
    "Address": ["Thing"],
    "Document": ["Thing"],
    "Folder": ["Document"],
    "Pages": ["Document"],
    "PlainText": ["Document"],
    "HyperText": ["Document"],
    "Table": ["Document"],
    "Image": ["Document"],
    "Email": ["Document"],
    "Payment": ["Interval"],
    "Membership": ["Interval"],
    "Mention": [],
}
CAPTIONS: dict[str, list[str]] = {
    "Thing": ["name"],
    "Address": ["full", "city"],
    "Document": ["fileName", "title", "name"],
    "Payment": ["purpose", "amountEur"],
    "Membership": ["role"],
    "Mention": ["name"],
}
LABELS = {"LegalEntity": "Legal entity", "PlainText": "Text file", "HyperText": "Web page", "Pages": "Pages document"}
GROUPS = {"countries": "country", "names": "name", "dates": "date", "languages": "language", "entities": "entity", "addresses": "address", "checksums": "checksum", "mimetypes": "mimetype"}
PROPS: dict[str, dict[str, str]] = {
    "Thing": {"name": "name", "alias": "name", "country": "country", "notes": "text"},
    "Document": {"fileName": "string", "contentHash": "checksum", "fileSize": "number", "mimeType": "mimetype", "parent": "entity", "title": "string", "author": "string", "bodyText": "text"},
}
STUBS = {"children"}  # computed inverse properties that never hold statements


@dataclass
class Registry:
    parents: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in PARENTS.items()})
    props: dict[str, dict[str, str]] = field(default_factory=lambda: {k: dict(v) for k, v in PROPS.items()})

    @classmethod
    def from_props(cls, schema_props: DataFrame) -> "Registry":
        """The seed with the rows of a ``schema_props`` table (metadata; its size is that of the schema)."""
        registry = cls()
        for row in schema_props.select("schema", "prop", "prop_type").distinct().collect():
            if row["schema"] and row["prop"]:
                registry.parents.setdefault(row["schema"], [])
                registry.props.setdefault(row["schema"], {})[row["prop"]] = row["prop_type"]
        return registry

    def ancestors(self, name: str) -> list[str]:
        """The type itself and all above it, nearest first."""
        out, queue = [], [name]
        while queue:
            here = queue.pop(0)
            if here not in out and here in self.parents:
                out.append(here)
                queue += self.parents[here]
        return out

    def descendants(self, name: str) -> list[str]:
        return sorted(s for s in self.parents if name in self.ancestors(s))

    def common(self, a: str, b: str) -> str | None:
        """The more specific of two types if one is above the other, else their nearest common ancestor."""
        if b in self.ancestors(a):
            return a
        if a in self.ancestors(b):
            return b
        return next((s for s in self.ancestors(a) if s in self.ancestors(b)), None)

    def captions(self, name: str) -> list[str]:
        return next((CAPTIONS[s] for s in self.ancestors(name) if s in CAPTIONS), [])

    def label(self, name: str) -> str:
        return LABELS.get(name, name)

    def properties(self, name: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for s in reversed(self.ancestors(name)):
            out |= self.props.get(s, {})
        return {p: t for p, t in out.items() if p not in STUBS}

    def bucket(self, name: str) -> str:
        up = self.ancestors(name)
        return "mention" if "Mention" in up else "pages" if name == "Pages" else "document" if "Document" in up else "interval" if "Interval" in up else "thing"

    # column expressions: lookups in literal maps, inside whole-stage code generation

    def merge_column(self, schemata: Column) -> Column:
        """One type for a set of types: fold :meth:`common` over the names in order. Null if they have nothing in common."""
        pairs = {f"{a}|{b}": c for a in self.parents for b in self.parents if (c := self.common(a, b))}
        table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
        names = F.filter(F.array_sort(schemata), lambda s: s.isin(list(self.parents)))
        return F.aggregate(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), F.try_element_at(names, F.lit(1)), lambda acc, s: table[F.concat(acc, F.lit("|"), s)])

    def caption_column(self, schema: Column, properties: Column) -> Column:
        """The smallest value of the first caption property that has one, else the type's label."""
        out = F.lit(None).cast("string")
        for name in self.parents:
            choice = F.coalesce(*[F.array_min(properties[p]) for p in self.captions(name)], F.lit(self.label(name)))
            out = F.when(schema == name, choice).otherwise(out)
        return out

    def prop_frame(self, spark: SparkSession) -> DataFrame:
        """``schema, prop, prop_type`` with inherited properties."""
        rows = [(s, p, t) for s in self.parents for p, t in self.properties(s).items()]
        return spark.createDataFrame(rows, "schema string, prop string, prop_type string")

    def bucket_column(self, schema: Column) -> Column:
        table = F.create_map(*[F.lit(x) for s in self.parents for x in (s, self.bucket(s))])
        return F.coalesce(table[schema], F.lit("thing"))
