"""Parsing of chat lines, for operators that run over Arrow batches.

Six shapes of a line are known: ``[H:MM:SS] user: text``, ``user [H:MM:SS]: text``,
``user: text``, a JSON object, ``time=.. | user=.. | text=..`` with its fields in any
order, and bare text. A field that a shape lacks is None. Blank lines are no
messages; text that only looks like a shape (bad JSON) is bare text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import table

BRACKET = re.compile(r"\[(\d{1,2}:\d\d(?::\d\d)?)\]\s*(?:-\s*)?(?:([^\s:\[\]]{1,40}):(?!//)\s*)?(.*)", re.S)
USER_BRACKET = re.compile(r"([^\s:\[\]]{1,40})\s*\[(\d{1,2}:\d\d(?::\d\d)?)\]\s*:?\s*(.*)", re.S)
PLAIN = re.compile(r"([^\s:\[\]]{1,40}):(?!//)\s+(.*)", re.S)
FIELD = re.compile(r"\s*\|\s*(?=(?:time|user|text)=)")
NOT_ALNUM = re.compile(r"[\W_]+")


def parse_line(raw: str) -> tuple[str | None, str | None, str]:
    """(time, user, text) of a non-blank line."""
    s = raw.strip()
    first = s[0]
    if first == "[":
        m = BRACKET.match(s)
        if m:
            return m[1], m[2], m[3]
    elif first == "{" and s[-1] == "}":
        try:
            o = json.loads(s)
        except (ValueError, RecursionError):
            return None, None, s
        if isinstance(o, dict) and "text" in o:
            t, u, x = o.get("time"), o.get("user"), o["text"]
            return None if t is None else str(t), None if u is None else str(u), "" if x is None else str(x)
        return None, None, s
    elif first in "tu" and s[4:5] == "=" and "text=" in s:
        parts = dict(p.split("=", 1) for p in FIELD.split(s) if "=" in p)
        if "text" in parts and parts.keys() <= {"time", "user", "text"}:
            return parts.get("time"), parts.get("user"), parts["text"].strip()
    m = PLAIN.match(s)
    if m:
        return None, m[1], m[2]
    m = USER_BRACKET.match(s)
    if m:
        return m[2], m[1], m[3]
    return None, None, s


def alnum_key(value: str) -> str:
    """Letters and digits only, without case and compatibility differences."""
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value)
    return NOT_ALNUM.sub("", value.casefold())


def seconds(time: str | None) -> int | None:
    """Seconds of day of ``H:MM[:SS]``; None where it isn't one."""
    if not time:
        return None
    try:
        parts = [int(p) for p in time.split(":")]
    except ValueError:
        return None
    if not 2 <= len(parts) <= 3:
        return None
    return parts[0] * 3600 + parts[1] * 60 + (parts[2] if len(parts) == 3 else 0)


def lines_of(body: str | list[str | None] | None) -> list[str]:
    """The messages of a record: non-blank lines of a chat, or non-blank elements of a list."""
    if body is None:
        return []
    if isinstance(body, str):
        body = body.split("\n")
    return [x for x in body if x and not x.isspace()]


def over_records(
    tables: list[tuple[str, DataFrame, str, str]],
    rows_of: Callable[[int, list[str]], Iterator[tuple]],
    schema: str,
    columns: list[tuple[str, pa.DataType]],
) -> DataFrame:
    """Run ``rows_of(rec_id, messages)`` over each (name, table, key, body column) and union the rows behind a column ``tbl``.

    Narrow: no shuffle, one Arrow pass that reads two columns of each table.
    """
    arrow = pa.schema([("tbl", pa.string()), *columns])

    def run(name: str):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                out: list[tuple] = []
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    messages = lines_of(body)
                    if messages:
                        out.extend(rows_of(key, messages))
                cols = list(zip(*out)) if out else [[] for _ in columns]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), *(pa.array(c, t) for c, (_, t) in zip(cols, columns))], schema=arrow)

        return batches

    parts = [df.select(F.col(key).alias("rec_id"), F.col(body).alias("body")).where("body IS NOT NULL").mapInArrow(run(name), f"tbl string, {schema}") for name, df, key, body in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chat_tables(spark, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    """The two tables with chat records, in the form that over_records takes."""
    return [
        ("moment_data", table(spark, sf_dir, "moment_data"), "moment_id", "messages"),
        ("summary_pairs", table(spark, sf_dir, "summary_pairs"), "pair_id", "chat"),
    ]
