"""One form for texts that look the same.

Compatibility decomposition (but for super- and subscripts, circled signs,
fractions and squared words, which look different from what they decompose to),
look-alike letters of other scripts mapped to one, default-ignorable code points
removed, white space of one kind, then composition. Case folding is optional: for
comparing looks it is off, since another letter case is another look. Computed once
per distinct value of a batch.

Defined cases: null stays null; documents without doc_id are in no pair or class; blank and empty texts give their form but are no
cases of equal looks; line breaks of any kind are one line feed, other white space
is a plain space, white space at line ends and around the text is dropped (it can't be seen).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import hot_joined, stored

# Letters and signs of one shape, each line in the order of the Latin or plain counterparts named first.
SAME_SHAPE = {
    "AaBCcEeGHhIiJjKMNOoPpQSsTVvWXxYyZ": "АаВСсЕеԌНһІіЈјКМΝОоРрԚЅѕТѴѵԜХхҮуΖ",
    "ABEHIKMOPTXYZ": "ΑΒΕΗΙΚΜΟΡΤΧΥΖ",
    "aopviuy": "αορνιυγ",
    "dglqwfnhosuSUOLTVJ": "ԁɡӏԛԝẝոһօѕսՏՍՕԼͲⴸԺ",
    "----'": "‐‑‒﹣ʼ",
}
_KEEP = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
_BREAKS = re.compile(r"\r\n?|[\n\v\f\x1c-\x1e\x85  ]")
_SPACES = re.compile(r"[^\S\n]")


def _ignorable(c: int) -> bool:
    return (
        c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or any(a <= c <= b for a, b in ((0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)))
    )


class _Table(dict):
    """Code point -> replacement, worked out when first met."""

    shapes = {ord(b): a for line, others in SAME_SHAPE.items() for a, b in zip(line, others)}

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if _ignorable(c):
            out = ""
        else:
            d = unicodedata.decomposition(ch)
            if d.startswith("<") and d.split(" ", 1)[0] not in _KEEP:
                out = unicodedata.normalize("NFKD", ch)
            else:
                out = unicodedata.normalize("NFD", ch)
            out = "".join(self.shapes.get(ord(x), x) for x in out if not _ignorable(ord(x)))
        self[c] = out
        return out


TABLE = _Table()


def form(text: str | None, fold_case: bool = False) -> str | None:
    """The consistent form of a text."""
    if text is None:
        return None
    text = _BREAKS.sub("\n", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(TABLE))
    text = "\n".join(line.rstrip(" ") for line in _SPACES.sub(" ", text).split("\n")).strip()
    return text.casefold() if fold_case else text


def _forms(fold_case: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            d = batch.column(1).dictionary_encode()
            values = pa.array([form(t, fold_case) for t in d.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.DictionaryArray.from_arrays(d.indices, values).cast(pa.string())], ["doc_id", "form"])

    return run


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        d = batch.column(1).dictionary_encode()
        raw = d.dictionary.to_pylist()
        looks = [form(t) for t in raw]
        pick = [v for v in d.indices.to_pylist()]
        ok = [bool(f and not f.isspace()) for f in looks]
        keep = [i for i, v in enumerate(pick) if v is not None and ok[v]]
        f, r = [xxhash.xxh3_128_digest(x) for x in looks], [xxhash.xxh3_128_digest(x) for x in raw]
        ids = batch.column(0).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([f[pick[i]] for i in keep], pa.binary()), pa.array([r[pick[i]] for i in keep], pa.binary())], ["doc_id", "look", "raw"])


def consistent(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """(doc_id, form) of every document. Narrow."""
    return docs.select("doc_id", "text").mapInArrow(_forms(fold_case), "doc_id long, form string")


def look_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, look, copies, texts): per document with a visible text the class of its look, how many documents have it and how many different texts they are. Nothing is expanded, whatever the size of a class."""
    h = stored(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(_hashes, "doc_id long, look binary, raw binary"), "p10-looks")
    texts = stored(h.groupBy("look", "raw").agg(F.count("*").alias("n")).groupBy("look").agg(F.sum("n").alias("copies"), F.count("*").alias("texts")), "p10-classes")
    return hot_joined(h.select("doc_id", "look"), texts, ["look"], "copies", 40).select("doc_id", F.hex("look").alias("look"), "copies", "texts")


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), smaller first: documents whose texts differ but have the same form.

    Only looks with at least two different texts are expanded, and only between
    different texts: copies of one text are never paired with each other.
    """
    h = stored(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(_hashes, "doc_id long, look binary, raw binary"), "p10-looks")
    texts = stored(h.groupBy("look", "raw").agg(F.count("*").alias("copies")), "p10-texts")
    many = stored(texts.groupBy("look").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("n > 1").select("look", "copies"), "p10-many")
    members = stored(hot_joined(h, many, ["look"], "copies", 32).drop("copies"), "p10-members")
    many = many.select("look")
    a = members.select(F.col("doc_id").alias("doc_a"), "look", F.col("raw").alias("raw_a"))
    b = members.select(F.col("doc_id").alias("doc_b"), "look", F.col("raw").alias("raw_b"))
    other = stored(texts.join(many, "look").select("look", F.col("raw").alias("raw_b")), "p10-others")
    links = texts.join(many, "look").select("look", F.col("raw").alias("raw_a")).join(other, "look").where("raw_a < raw_b")
    return a.join(links, ["look", "raw_a"]).join(b, ["look", "raw_b"]).select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
