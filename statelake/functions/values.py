"""Small value rules: names, origins, checksums, sizes, MIME types, public addresses."""

from __future__ import annotations

import mimetypes
import re
from functools import cache
from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_NAME = 255
RESERVED_DATASETS = {"catalog", "default"}
DEFAULT_ORIGIN = "default"
OCTET_STREAM = "application/octet-stream"
UNITS = {"": 1, "b": 1} | {f"{p}{tail}": base**n for n, p in enumerate("kmgtp", 1) for tail, base in (("", 1000), ("b", 1000), ("ib", 1024))}

# MIME types of archived files and the entity schema they become; anything else is a Document.
MIME_SCHEMATA = {
    "application/pdf": "Pages",
    "application/msword": "Pages",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Pages",
    "text/html": "HyperText",
    "text/xml": "HyperText",
    "application/xml": "HyperText",
    "text/plain": "PlainText",
    "text/rtf": "PlainText",
    "application/rtf": "PlainText",
    "text/csv": "Table",
    "application/vnd.ms-excel": "Table",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Table",
    "message/rfc822": "Email",
    "application/vnd.ms-outlook": "Email",
    "application/oebps-package+xml": "Email",
    "image/jpeg": "Image",
    "image/png": "Image",
    "image/gif": "Image",
    "image/tiff": "Image",
    "image/vnd.djvu": "Image",
    "image/vnd.adobe.photoshop": "Image",
}
_UNSAFE = re.compile(r"[/\\\x00-\x1f\x7f]")


def safe_name(value: str | None, what: str = "name") -> str:
    """``value`` if it can be one path segment, else ``ValueError``."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} is empty")
    if len(value) > MAX_NAME:
        raise ValueError(f"{what} is longer than {MAX_NAME} characters")
    if value in (".", "..") or ".." in value or _UNSAFE.search(value):
        raise ValueError(f"{what} {value!r} is not a safe path segment")
    return value


def validate_origin(value: str | None) -> str:
    return safe_name(value, "origin")


def validate_dataset_name(value: str | None) -> str:
    name = safe_name(value, "dataset")
    if name in RESERVED_DATASETS:
        raise ValueError(f"dataset name {name!r} is reserved")
    if not re.fullmatch(r"[a-z0-9_]+", name):
        raise ValueError(f"dataset name {name!r} holds other characters than lower-case letters, digits and '_'")
    return name


def validate_checksum(value: str | None) -> str:
    if not isinstance(value, str) or not re.fullmatch(r"[0-9a-f]{64}", value):
        raise ValueError(f"{value!r} is not a SHA-256 in lower hex")
    return value


def is_safe_name(column: Column) -> Column:
    """The rule of :func:`safe_name` for a column; null is unsafe."""
    ok = (F.length(F.trim(column)) > 0) & (F.length(column) <= MAX_NAME) & ~column.contains("..") & (column != ".") & ~column.rlike(r"[/\\\x00-\x1f\x7f]")
    return F.coalesce(ok, F.lit(False))


def parse_byte_size(text: str | int) -> int:
    """Bytes of ``8GB``, ``512 MiB``, ``100``."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"{text!r} is not a size in bytes")
    return int(float(m[1]) * UNITS[m[2].lower()])


def single_string(values: Column) -> Column:
    """The element of a list of exactly one, else null."""
    return F.when(F.size(values) == 1, values[0])


def resolve_origin(forced: str | None, own: Column, given: str | None = None) -> Column:
    """The origin of a row: one that is forced, else its own, else one given for the run, else the default."""
    return F.coalesce(F.lit(forced).cast("string"), own, F.lit(given).cast("string"), F.lit(DEFAULT_ORIGIN))


def normal_mime(column: Column) -> Column:
    """Lower case, without parameters; null if there is none."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(column, ";.*$", ""))), F.lit(""))


def pick_mime(values: Column, default: Column | None = None) -> Column:
    """The first MIME type that says something, else ``default``, else the general one."""
    known = F.filter(F.transform(values, normal_mime), lambda m: m.isNotNull() & (m != OCTET_STREAM))
    found = F.try_element_at(known, F.lit(1))
    return F.coalesce(found, F.lit(OCTET_STREAM)) if default is None else F.coalesce(found, default, F.lit(OCTET_STREAM))


def guess_mime(name: Column) -> Column:
    """The MIME type that a file name's ending stands for; null if it has none that is known. The table is Python's own."""
    table = F.create_map(*[F.lit(x) for pair in mime_endings().items() for x in pair])
    return table[F.nullif(F.regexp_extract(F.lower(name), r"(\.[a-z0-9]+)$", 1), F.lit(""))]


@cache
def mime_endings() -> dict[str, str]:
    return dict(sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items()))


def mime_schema(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_SCHEMATA.items() for x in pair])
    return F.coalesce(table[normal_mime(mime)], F.lit("Document"))


def public_url(template: str | None, dataset: str | Column, key: Column) -> Column:
    """The public address of an archive key; ``${dataset}`` in the template is replaced, by a name or by each row's own. Null without a template."""
    if not template:
        return F.lit(None).cast("string")
    if isinstance(dataset, Column):
        first, *others = (Template(template).safe_substitute(dataset="\0").rstrip("/") + "/").split("\0")
        return F.concat(F.lit(first), *[c for text in others for c in (dataset, F.lit(text))], key)
    return F.concat(F.lit(Template(template).safe_substitute(dataset=dataset).rstrip("/") + "/"), key)
