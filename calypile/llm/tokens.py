"""Encoding of whole texts with a public tokenizer, and decoding by raw bytes.

The tokenizer is a local rank file read by the tiktoken library. The driver reads the file once and broadcasts its bytes (under 1 MB, checked),
so executors need no copy. Texts longer than PIECE_CHARS are cut at safe boundaries: places where the tokenizer's own
pre-splitting always ends a piece, so that the ids of the parts, joined, are the ids of the whole text.

Null and empty texts have the empty list. Special tokens are never produced: their strings in a text are ordinary text.
Bytes that are not valid UTF-8 are replaced (U+FFFD) before encoding.
"""

from __future__ import annotations

import array
import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calypile.session import spread

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The pattern by which the tokenizers of FOLDER split text before merging; a fixed value published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RANK_FILE = 16 << 20
PIECE_CHARS = 1 << 16
#: Tokens after which a batch is sent back to the JVM.
BATCH_TOKENS = 1 << 20
#: Before a line feed that a visible ASCII character follows, and before a single space between a visible character and a letter.
_SAFE = re.compile(r"(?=\n[!-~])|(?<=[!-~])(?= [A-Za-z])")
_encodings: dict[str, object] = {}


def rank_bytes(folder: str = FOLDER, name: str = NAME) -> bytes:
    """The rank file's content, of a checked size."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes):
    """The tiktoken encoding of a rank file; built once in each Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding(f"ranks-{key[:8]}", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def safe_parts(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """text in parts of about limit characters, cut at safe boundaries only; a stretch without one stays whole."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut or cut.start() >= len(text):
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def encoder(ranks: bytes) -> Callable[[str | None], list[int]]:
    """The function from a text to its ids."""
    encode = encoding(ranks).encode_ordinary

    def ids(text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE_CHARS:
            return encode(text)
        return [i for part in safe_parts(text) for i in encode(part)]

    return ids


def strings(column: pa.Array) -> list[str | None]:
    """The values of a string column; invalid UTF-8 is replaced."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encode_ids(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, ids array<int>) of every row; no shuffle, the texts never leave their partition."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(ranks.value)
        for batch in batches:
            keys, flat, offsets, first = batch.column(0), array.array("i"), [0], 0
            texts = strings(batch.column(1))
            for row, value in enumerate(texts):
                flat.extend(ids(value))
                offsets.append(len(flat))
                if len(flat) >= BATCH_TOKENS or row + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, row + 1 - first), lists], names=[key, "ids"])
                    flat, offsets, first = array.array("i"), [0], row + 1

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, n_tokens bigint) of every row; null and empty texts have 0."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(ranks.value)
        for batch in batches:
            counts = [len(ids(value)) for value in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode_bytes(spark: SparkSession, encoded: DataFrame, key: str, ids: str = "ids", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, bytes binary): the joined raw bytes of the ids. Bytes, as a cut list may end inside a character; null ids give null."""
    ranks = spark.sparkContext.broadcast(rank_bytes(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoding(ranks.value).decode_bytes
        for batch in batches:
            out = [None if x is None else raw(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, n_bytes, same): whether encoding and decoding by raw bytes gives the text's UTF-8 bytes back; null counts as empty."""
    ranks = df.sparkSession.sparkContext.broadcast(rank_bytes(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = encoder(ranks.value), encoding(ranks.value).decode_bytes
        for batch in batches:
            texts = [(t or "").encode() for t in strings(batch.column(1))]
            same = [raw(ids(t.decode())) == t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(same)], names=[key, "n_bytes", "same"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, same boolean")
