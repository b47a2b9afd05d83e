"""Joining parquet files by copying their encoded column chunks.

No page is decompressed or decoded. The column chunks of each input are copied
byte for byte; only the footer is new: the row groups of all inputs, with every
file offset moved by the distance its bytes travelled.

Small chunks of one column are laid behind each other and form one chunk of
several pages (a *merged* row group), if they are compatible: without a
dictionary page, of one codec and one set of encodings. Others keep their row
groups. A merged chunk states no minimum and maximum, since those of its pages
would have to be decoded.

The footer is a struct in the public thrift compact protocol. It is walked, not
decoded: fields this module does not know are copied as the bytes they are, and
only the numbers that change are written anew.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.parquet as pq

MAGIC = b"PAR1"

# Wire types of the thrift compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)

# Field ids of the parquet format.
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_KEY_VALUES = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META = 1, 2, 3
CHUNK_INDEX_FIELDS = {4, 5, 6, 7}  # page index: lies outside the chunks and is not carried over
META_PACKED, META_DATA_PAGE, META_INDEX_PAGE, META_DICTIONARY_PAGE = 7, 9, 10, 11
META_OFFSETS = {META_DATA_PAGE, META_INDEX_PAGE, META_DICTIONARY_PAGE}
META_BLOOM_FIELDS = {14, 15}
META_KIND_FIELDS = {1, 2, 3, 4}  # type, encodings, path, codec: equal for all pages of one chunk
META_VALUES, META_UNPACKED = 5, 6

# A chunk below this size is merged with its like; a merged row group is closed at this size.
MERGE_BELOW = 1 << 20
GROUP_BYTES = 64 << 20


class IncompatibleFiles(ValueError):
    """The inputs cannot share one footer."""


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the position after it."""
    byte = data[at]
    at += 1
    if byte < 128:
        return byte, at
    value, shift = byte & 127, 7
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _read_int(data: bytes, at: int) -> tuple[int, int]:
    n, at = _read_varint(data, at)
    return (n >> 1) ^ -(n & 1), at


def _read_field(data: bytes, at: int, last: int) -> tuple[int, int, int]:
    """Field id, wire type and position of the value. Must not be called on a stop byte."""
    head = data[at]
    at += 1
    if head >> 4:
        return last + (head >> 4), head & 15, at
    field, at = _read_int(data, at)
    return field, head & 15, at


def _read_list(data: bytes, at: int) -> tuple[int, int, int]:
    """Number of items, their wire type, position of the first."""
    head = data[at]
    at += 1
    if head >> 4 < 15:
        return head >> 4, head & 15, at
    size, at = _read_varint(data, at)
    return size, head & 15, at


def _skip(data: bytes, at: int, kind: int) -> int:
    """The position after a value."""
    if kind == I64 or kind == I32 or kind == I16:
        while data[at] > 127:
            at += 1
        return at + 1
    if kind == BINARY:
        size, at = _read_varint(data, at)
        return at + size
    if kind == STRUCT:
        while head := data[at]:
            at += 1
            if not head >> 4:
                while data[at] > 127:
                    at += 1
                at += 1
            inner = head & 15
            if inner > FALSE:
                at = _skip(data, at, inner)
        return at + 1
    if kind == LIST or kind == SET:
        size, inner, at = _read_list(data, at)
        if inner == TRUE or inner == FALSE or inner == BYTE:
            return at + size
        for _ in range(size):
            at = _skip(data, at, inner)
        return at
    if kind == BYTE:
        return at + 1
    if kind == DOUBLE:
        return at + 8
    if kind == TRUE or kind == FALSE:
        return at
    raise IncompatibleFiles(f"footer holds wire type {kind}")


def _varint(n: int) -> bytes:
    if n < 128:
        return bytes((n,))
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _head(field: int, last: int, kind: int) -> bytes:
    delta = field - last
    return bytes((delta << 4 | kind,)) if 0 < delta < 16 else bytes((kind,)) + _int(field)


def _list_head(n: int) -> bytes:
    return bytes((n << 4 | STRUCT,)) if n < 15 else bytes((0xF0 | STRUCT,)) + _varint(n)


def footer_of(image: bytes) -> bytes:
    if len(image) < 12 or image[:4] != MAGIC or image[-4:] != MAGIC:
        raise IncompatibleFiles("not a parquet file")
    size = struct.unpack("<I", image[-8:-4])[0]
    if size > len(image) - 12:
        raise IncompatibleFiles("the footer is longer than the file")
    return image[-8 - size : -8]


def schema_of(image: bytes) -> bytes:
    """The footer's schema, as the bytes it is stored in."""
    data, at, last = footer_of(image), 0, 0
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        end = _skip(data, at, kind)
        if field == FILE_SCHEMA:
            return data[at:end]
        at = end
    raise IncompatibleFiles("the footer has no schema")


def _walk_meta(data: bytes, at: int, out: list) -> tuple[int, int, int]:
    """Copy a chunk's metadata to ``out``, offsets as numbers. Returns the position after it and the byte range of the pages."""
    last = kept = first = dictionary = packed = 0
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        end = _skip(data, at, kind)
        if field in META_OFFSETS:
            offset, _ = _read_int(data, at)
            out += (_head(field, kept, kind), offset or b"\0")
            kept = field
            if field == META_DATA_PAGE:
                first = offset
            elif field == META_DICTIONARY_PAGE:
                dictionary = offset
        elif field not in META_BLOOM_FIELDS:
            if field == META_PACKED:
                packed, _ = _read_int(data, at)
            out += (_head(field, kept, kind), data[at:end])
            kept = field
        at = end
    out.append(b"\0")
    start = min(o for o in (first, dictionary) if o) if first or dictionary else 0  # 0: there is no such page
    return at + 1, start, start + packed


def _walk_chunk(data: bytes, at: int, out: list) -> tuple[int, int, int]:
    """As :func:`_walk_meta`, for the chunk's whole entry."""
    last = kept = 0
    span = None
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        if field == CHUNK_META:
            out.append(_head(field, kept, kind))
            at, *span = _walk_meta(data, at, out)
        elif field == CHUNK_OFFSET:
            offset, at = _read_int(data, at)
            out += (_head(field, kept, kind), offset or b"\0")
        elif field == CHUNK_PATH:
            raise IncompatibleFiles("a column chunk lies in another file")
        else:
            end = _skip(data, at, kind)
            if field not in CHUNK_INDEX_FIELDS:
                out += (_head(field, kept, kind), data[at:end])
            else:
                last, at = field, end
                continue
            at = end
        kept = field
    if span is None:
        raise IncompatibleFiles("a column chunk has no metadata")
    out.append(b"\0")
    return at + 1, *span


def _walk_group(data: bytes, at: int, ordinal: int) -> tuple[int, list, int, int, int]:
    """Copy a row group's entry. Returns the position after it, the copy, its rows and the byte range of its pages."""
    out: list = []
    last = kept = rows = 0
    lo, hi = None, 4
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        if field == GROUP_ORDINAL:
            at = _skip(data, at, kind)
            continue
        out.append(_head(field, kept, kind))
        kept = field
        if field == GROUP_COLUMNS:
            size, _, at = _read_list(data, at)
            out.append(_list_head(size))
            for _ in range(size):
                at, start, end = _walk_chunk(data, at, out)
                if end > start:  # a chunk without pages has no place in the file
                    lo, hi = start if lo is None else min(lo, start), max(hi, end)
        elif field == GROUP_OFFSET:
            offset, at = _read_int(data, at)
            out.append(offset or b"\0")
        else:
            end = _skip(data, at, kind)
            if field == GROUP_ROWS:
                rows, _ = _read_int(data, at)
            out.append(data[at:end])
            at = end
    if kept < GROUP_ORDINAL and ordinal < 32768:
        out += (_head(GROUP_ORDINAL, kept, I16), _int(ordinal))
    out.append(b"\0")
    return at + 1, out, rows, hi if lo is None else lo, hi


def _kinds(data: bytes) -> list[bytes]:
    """Of each column of the first row group, what :data:`META_KIND_FIELDS` hold, as bytes ready to be written."""
    at = last = 0
    found: list[bytes] = []
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        if field != FILE_GROUPS:
            at = _skip(data, at, kind)
            continue
        size, _, at = _read_list(data, at)
        inner = 0
        while data[at]:
            field, kind, at = _read_field(data, at, inner)
            inner = field
            if field != GROUP_COLUMNS:
                at = _skip(data, at, kind)
                continue
            columns, _, at = _read_list(data, at)
            for _ in range(columns):
                at, value = _kind_of_chunk(data, at)
                found.append(value)
        break
    return found


def _kind_of_chunk(data: bytes, at: int) -> tuple[int, bytes]:
    last, value = 0, b""
    while data[at]:
        field, kind, at = _read_field(data, at, last)
        last = field
        end = _skip(data, at, kind)
        if field == CHUNK_META:
            inner = kept = 0
            out = []
            while data[at]:
                part, of, at = _read_field(data, at, inner)
                inner = part
                stop = _skip(data, at, of)
                if part in META_KIND_FIELDS:
                    out += (_head(part, kept, of), data[at:stop])
                    kept = part
                at = stop
            value = b"".join(out)
        at = end
    return at + 1, value


class _Merged:
    """One row group under way: per column the pages taken up so far."""

    def __init__(self, signature: tuple, kinds: list[bytes]):
        self.signature, self.kinds = signature, kinds
        self.pages: list[list[bytes]] = [[] for _ in kinds]
        self.sums = [[0, 0, 0] for _ in kinds]  # values, bytes unpacked, bytes packed
        self.rows = self.bytes = 0

    def add(self, image: bytes, rows: int, spans: list[tuple[int, int, int, int]]) -> None:
        for pages, sums, (start, packed, unpacked, values) in zip(self.pages, self.sums, spans):
            pages.append(image[start : start + packed])
            sums[0] += values
            sums[1] += unpacked
            sums[2] += packed
            self.bytes += packed
        self.rows += rows

    def entry(self, at: int, ordinal: int) -> tuple[bytes, list[bytes]]:
        """The row group's footer entry for pages that begin at ``at``, and the pages."""
        out, body, start = [_head(GROUP_COLUMNS, 0, LIST), _list_head(len(self.kinds))], [], at
        for kind, pages, (values, unpacked, packed) in zip(self.kinds, self.pages, self.sums):
            meta = kind + _head(META_VALUES, max(META_KIND_FIELDS), I64) + _int(values) + _head(META_UNPACKED, META_VALUES, I64) + _int(unpacked)
            meta += _head(META_PACKED, META_UNPACKED, I64) + _int(packed) + _head(META_DATA_PAGE, META_PACKED, I64) + _int(at) + b"\0"
            out += (_head(CHUNK_OFFSET, 0, I64), _int(at), _head(CHUNK_META, CHUNK_OFFSET, STRUCT), meta, b"\0")
            body += pages
            at += packed
        out += (_head(2, GROUP_COLUMNS, I64), _int(sum(s[1] for s in self.sums)), _head(GROUP_ROWS, 2, I64), _int(self.rows), _head(GROUP_OFFSET, GROUP_ROWS, I64), _int(start))
        out += (_head(6, GROUP_OFFSET, I64), _int(self.bytes), _head(GROUP_ORDINAL, 6, I16), _int(ordinal)) if ordinal < 32768 else ()
        return b"".join([*out, b"\0"]), body


def _mergeable(meta: pq.FileMetaData) -> list[tuple[int, tuple, list[tuple[int, int, int, int]]]] | None:
    """Rows, signature and page spans of each row group; ``None`` if a chunk is large or has a dictionary page."""
    found = []
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        signature, spans = [], []
        for j in range(group.num_columns):
            chunk = group.column(j)
            if chunk.has_dictionary_page or chunk.total_compressed_size > MERGE_BELOW:
                return None
            signature.append((chunk.compression, chunk.encodings))
            spans.append((chunk.data_page_offset, chunk.total_compressed_size, chunk.total_uncompressed_size, chunk.num_values))
        found.append((group.num_rows, tuple(signature), spans))
    return found


class BlockCopier:
    """Collects parquet images into one larger image."""

    def __init__(self):
        self.body: list[bytes] = [MAGIC]
        self.size = len(MAGIC)
        self.head: list[tuple[int, int, bytes]] | None = None
        self.schema = self.start = b""
        self.groups: list[bytes] = []
        self.merged: _Merged | None = None
        self.rows = self.files = self.blocks = 0  # blocks: row groups taken up

    def add(self, image: bytes) -> int:
        """Copy one file's column chunks; returns its number of rows. Its schema must equal that of the first file."""
        data = footer_of(image)
        # a footer begins with the version and the schema: the same bytes mean the same schema
        if self.head is None or not data.startswith(self.start):
            self._take_head(data)
        try:
            meta = pq.read_metadata(pa.BufferReader(image))
        except (pa.ArrowException, OSError) as error:
            raise IncompatibleFiles(str(error)) from error
        parts = _mergeable(meta)
        rows = self._copy_groups(data, image) if parts is None else self._merge_groups(data, image, parts)
        if rows != meta.num_rows:
            raise IncompatibleFiles("row groups and footer disagree on the number of rows")
        self.blocks += meta.num_row_groups
        self.rows += rows
        self.files += 1
        return rows

    def _take_head(self, data: bytes) -> None:
        """Check the schema; of the first file also keep all file-level fields."""
        at = last = 0
        head, schema, start = [], b"", b""
        while data[at]:
            field, kind, at = _read_field(data, at, last)
            last = field
            end = _skip(data, at, kind)
            if field == FILE_SCHEMA:
                schema, start = data[at:end], data[:end]
            head.append((field, kind, b"" if field == FILE_GROUPS else data[at:end]))
            at = end
        if self.head is None:
            self.head, self.schema, self.start = head, schema, start
        elif schema != self.schema:
            raise IncompatibleFiles("schemas differ")

    def _merge_groups(self, data: bytes, image: bytes, parts: list) -> int:
        for rows, signature, spans in parts:
            if not rows:
                continue
            if any(not 4 <= start <= start + packed <= len(image) for start, packed, _, _ in spans):
                raise IncompatibleFiles("a column chunk lies outside of the file")
            if self.merged is not None and (self.merged.signature != signature or self.merged.bytes > GROUP_BYTES):
                self._close_group()
            if self.merged is None:
                self.merged = _Merged(signature, _kinds(data))
            self.merged.add(image, rows, spans)
        return sum(rows for rows, _, _ in parts)

    def _close_group(self) -> None:
        if self.merged is not None:
            entry, pages = self.merged.entry(self.size, len(self.groups))
            self.groups.append(entry)
            self.body += pages
            self.size += self.merged.bytes
            self.merged = None

    def _copy_groups(self, data: bytes, image: bytes) -> int:
        """Row groups as they are."""
        self._close_group()
        at = last = 0
        found: list[tuple[list, int, int, int]] = []
        while data[at]:
            field, kind, at = _read_field(data, at, last)
            last = field
            if field != FILE_GROUPS:
                at = _skip(data, at, kind)
                continue
            size, _, at = _read_list(data, at)
            for _ in range(size):
                at, entry, rows, lo, hi = _walk_group(data, at, len(self.groups) + len(found))
                found.append((entry, rows, lo, hi))
        for entry, _, lo, hi in found:
            if not 4 <= lo <= hi <= len(image):
                raise IncompatibleFiles("a column chunk lies outside of the file")
            distance = self.size - lo
            self.body.append(image[lo:hi])
            self.size += hi - lo
            self.groups.append(b"".join([_int(p + distance) if type(p) is int else p for p in entry]))
        return sum(rows for _, rows, _, _ in found)

    def finish(self) -> bytes:
        if self.head is None:
            raise IncompatibleFiles("no input")
        self._close_group()
        out, last = [], 0
        for field, kind, value in self.head:
            out.append(_head(field, last, kind))
            last = field
            if field == FILE_ROWS:
                out.append(_int(self.rows))
            elif field == FILE_GROUPS:
                out.append(_list_head(len(self.groups)))
                out += self.groups
            else:
                out.append(value)
        out.append(b"\0")
        footer = b"".join(out)
        return b"".join([*self.body, footer, struct.pack("<I", len(footer)), MAGIC])


def join_images(images: Iterable[bytes]) -> bytes:
    """One parquet file with the row groups of all ``images``, in order."""
    copier = BlockCopier()
    for image in images:
        copier.add(image)
    return copier.finish()
