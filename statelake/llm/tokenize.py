"""Token ids of a byte-level BPE vocabulary.

The public vocabulary (bytes → rank) is turned into a sentencepiece BPE model in
memory, by writing the model's protocol buffer directly: one piece per token,
spelled with the usual one-character-per-byte alphabet, scored by its negative
rank, with identity normalisation. Sentencepiece then merges by the best score,
which is the lowest rank, and piece numbers are the vocabulary's own ids.

Texts are cut into pre-tokens by the vocabulary's pattern. Each distinct
pre-token of a batch is encoded once; frequent ones are kept by the worker.

Edge cases: null and empty texts give an empty list; names of special tokens are
ordinary text; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the pre-token pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

CACHE_ENTRIES = 200_000
CACHE_LENGTH = 48
CHUNK = 256


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """A visible character for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in pairs]


def _tag(field: int, kind: int) -> bytes:
    return _varint(field << 3 | kind)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _blob(field: int, value: bytes) -> bytes:
    return _tag(field, 2) + _varint(len(value)) + value


def _int(field: int, value: int) -> bytes:
    return _tag(field, 0) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece ``i`` is token ``i``; the unknown piece, which never occurs, comes last."""
    alphabet = byte_alphabet()
    pieces = [_blob(1, "".join(alphabet[b] for b in token).encode()) + _tag(2, 5) + struct.pack("<f", -float(rank)) + _int(3, 1) for rank, token in enumerate(tokens)]
    pieces.append(_blob(1, b"<unk>") + _tag(2, 5) + struct.pack("<f", 0.0) + _int(3, 2))
    unknown, none = len(tokens), (1 << 64) - 1  # -1 as a varint: the model has no such piece
    trainer = _int(3, 2) + _int(4, len(pieces)) + _int(40, unknown) + _int(41, none) + _int(42, none) + _int(43, none)
    normalizer = _blob(1, b"identity") + _blob(2, b"") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(_blob(1, p) for p in pieces) + _blob(2, trainer) + _blob(3, normalizer)


class Encoder:
    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.tokens = load_ranks(path)
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self._split = regex.compile(PATTERN).findall
        self._alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self._cache: dict[str, list[int]] = {}

    def _encode_new(self, words: Iterable[str]) -> dict[str, list[int]]:
        words = list(words)
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._alphabet) for w in words]
        return dict(zip(words, self._pieces.encode(mapped, out_type=int, num_threads=1)))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self._split(t) if t else [] for t in texts]
        cache = self._cache
        new = self._encode_new({w for words in split for w in words} - cache.keys())
        known = cache | new if len(new) > len(cache) else None
        get = known.__getitem__ if known is not None else lambda w: cache[w] if w in cache else new[w]
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += get(w)
            out.append(ids)
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
        cache.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_LENGTH)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``<key>, ids`` for every row, whole texts."""
    path = path or vocabulary()
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_batch
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``<key>, n_tokens`` for every row; the ids themselves do not leave the worker."""
    path = path or vocabulary()
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_batch
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                counts = [len(ids) for ids in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, type=pa.int64())], names=[key, "n_tokens"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode_ids(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``<key>, text`` from ``<key>, ids`` by the inverse mapping; a null list gives an empty text."""
    path = path or vocabulary()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in batches:
            texts = [decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
