"""Encoding of texts by a public byte-level BPE, and decoding back to the exact bytes.

The rank file is read once per Python worker from a path parameter. Long texts are
split first at positions where the tokenizer's own pre-splitting always breaks
(before white space that follows other signs, between a letter and a digit), so
pieces encode to the same ids as the whole.

Defined cases: null and empty texts give an empty list of ids; special tokens are
never produced, their strings are ordinary text; surrogates can't occur in Spark
strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function here.
RANKS = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this many characters are encoded in pieces of about this size.
PIECE = 1 << 16
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

#: The tokenizer's own pre-splitting fails on very long runs of white space; such a run is one piece but for its last sign, which may belong to what follows.
LONG_SPACE = regex.compile(r"\p{White_Space}{2048,}")

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = RANKS) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least ``size`` characters that end at safe boundaries; whole where there is none."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(text: str | None, enc: tiktoken.Encoding, size: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= min(size, 2048):
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += [i for p in pieces(text[at : m.start()], size) for i in enc.encode_ordinary(p)]
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    out += [i for p in pieces(text[at:], size) for i in enc.encode_ordinary(p)]
    return out


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of every text. Narrow; reads two columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in it:
            ids = [encode_text(t, enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, n_tokens) without shipping the ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode_text(t, enc)) for t in batch.column(1).to_pylist()], pa.int64())], [key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long")


def decoded(ids: DataFrame, key: str = "doc_id", path: str = RANKS) -> DataFrame:
    """(key, text) back from the raw bytes of the ids; null ids give null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in it:
            texts = [None if i is None else enc.decode_bytes(i).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return ids.select(key, F.col("ids")).mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, text string")
