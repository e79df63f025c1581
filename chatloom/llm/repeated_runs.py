"""Runs of the same or nearly the same message.

Per record, in order: every message is normalised to its words (no case,
punctuation, spacing or stretched letters); messages that share a common text with
the run before them get the run's canonical event, each event one Unicode code
point. A record is then one symbol string, runs are the matches of a backreference,
and their spans are mapped back to messages and times.

Defined cases: messages without words (emoji, symbols only) compare by their
symbols; blank messages don't break a run; a record of one message has no run; a
time that is missing or no time gives a null duration; a clock that passes
midnight counts on into the next day.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.llm.lines import over_records, parse_line, seconds

#: Texts with fewer letters must be equal.
MIN_LETTERS = 14
DOUBLED = re.compile(r"([^\W\d_])\1+")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
PUNCT = re.compile(r"[^\w\s]|_")
RUN = re.compile(r"(.)\1+", re.S)
FIRST_SYMBOL, SYMBOLS = 0xE000, 0x10FFFF - 0xE000 - 1


class Text(NamedTuple):
    """A text without case, punctuation and spaces: ``tight`` with every repeated letter once, ``loose`` with stretches only (three or more) once."""

    tight: str
    loose: str
    whole: str
    long: bool


def spaced(text: str) -> str:
    """Words without case and punctuation; the symbols themselves where there is no word."""
    if text.isascii():
        w = PUNCT.sub("", text.lower()).split()
    else:
        folded = unicodedata.normalize("NFKC", text).casefold()
        w = (PUNCT.sub(lambda m: "" if unicodedata.category(m[0])[0] in "PC" else m[0], folded)).split()
    return " ".join(w or text.split())


def forms(words: str) -> tuple[Text, Text | None]:
    """The texts of spaced words, and of the same without the closing word (None for a single word or a short text)."""
    full = _text(words)
    cut = words.rfind(" ")
    return full, _text(words[:cut]) if cut > 0 and full.long else None


def _text(words: str) -> Text:
    tight, loose, whole = (x.replace(" ", "") for x in (DOUBLED.sub(r"\1", words), STRETCHED.sub(r"\1", words), words))
    return Text(tight, loose, whole, sum(map(str.isalpha, loose)) >= MIN_LETTERS)


def may_run(a: str, b: str) -> bool:
    """False only where two tight texts can't be one edit each from a common one: of three pieces apart from each other, two edits leave one whole."""
    if a == b:
        return True
    if len(a) < 16 or len(b) < 16:
        return min(len(a), len(b)) >= 8
    return a[:3] == b[:3] or a[-3:] == b[-3:] or a[6:10] in b or b[6:10] in a


def one_typo(a: str, b: str) -> bool:
    """Equal but for one letter inserted, dropped, changed or swapped with its neighbour; digits may not differ."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = len(commonprefix((a, b)))
    if n == m:
        if a[i].isdigit() or b[i].isdigit():
            return False
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and not b[i + 1].isdigit() and a[i + 2 :] == b[i + 2 :])
    if n < m:
        a, b = b, a
    return not a[i].isdigit() and a[i + 1 :] == b[i:]


def fits(message: tuple[Text, Text | None], common: Text) -> bool:
    """Is a message within one typo or one added closing word of a common text?"""
    full, short = message
    if full.tight == common.tight:
        return True
    if not common.long:
        return False
    return (short is not None and short.tight == common.tight) or one_typo(full.loose, common.loose) or one_typo(full.tight, common.tight) or one_typo(full.whole, common.whole)


def between(a: Text, b: Text) -> Iterator[Text]:
    """Texts one typo from both of two long texts that differ by two: the first of the differences is taken from ``b``."""
    x, y = a.loose, b.loose
    if abs(len(x) - len(y)) <= 2 and a.long and b.long:
        i = len(commonprefix((x, y)))
        for c in (y[: i + 2] + x[i + 2 :], y[: i + 1] + x[i + 1 :], y[: i + 1] + x[i:], y[:i] + x[i + 1 :]):
            if one_typo(c, x) and one_typo(c, y):
                yield Text(DOUBLED.sub(r"\1", c), c, c, True)


def symbols(texts: list[str]) -> str:
    """One code point a message; neighbours share it where they are one run."""
    words = [spaced(t) for t in texts]
    tight = [DOUBLED.sub(r"\1", w).replace(" ", "") for w in words]
    near = [False, *map(may_run, tight, tight[1:]), False]
    out: list[str] = []
    known: dict[str, int] = {}
    run: dict[tuple[Text, Text | None], None] = {}
    commons: list[Text] = []
    symbol = 0
    for i, t in enumerate(tight):
        m = forms(words[i]) if near[i] or near[i + 1] else None
        if not near[i]:
            run = {}
        left: list[Text] = []
        if run and (m not in run or len(commons) > 1):
            left = [c for c in commons if fits(m, c)]
            if m not in run:
                own = [*m[:1], *([m[1]] if m[1] else []), *(between(m[0], next(iter(run))[0]) if not left and len(run) == 1 else ())]
                left += [c for c in own if c not in left and all(fits(o, c) for o in run)]
        elif run:
            left = commons
        if left:
            commons = left
            run[m] = None
        else:
            run = {m: None} if m else {}
            commons = [x for x in m or () if x]
            new = known.setdefault(t, len(known)) % SYMBOLS
            symbol = new if i == 0 or new != symbol else (new + 1) % SYMBOLS
        out.append(chr(FIRST_SYMBOL + symbol))
    return "".join(out)


def spans(texts: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each run of two or more messages."""
    return [m.span() for m in RUN.finditer(symbols(texts))]


def _found(key: int, messages: list[str]) -> Iterator[tuple]:
    for a, b in spans([parse_line(m)[2] for m in messages]):
        yield key, a + 1, b - a


def _collapsed(key: int, messages: list[str]) -> Iterator[tuple]:
    parsed = [parse_line(m) for m in messages]
    at = 0
    runs = spans([p[2] for p in parsed])
    for a, b in [*runs, (len(parsed), len(parsed))]:
        for i in range(at, a):
            yield key, i + 1, parsed[i][1], parsed[i][2], 1, None if seconds(parsed[i][0]) is None else 0
        if b > a:
            first, last = seconds(parsed[a][0]), seconds(parsed[b - 1][0])
            yield key, a + 1, parsed[a][1], parsed[a][2], b - a, None if first is None or last is None else (last - first) % 86400
        at = b


def repeated_runs(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, first_line, n_lines) of every maximal run. Narrow: no shuffle."""
    return over_records(tables, _found, "rec_id long, first_line long, n_lines long", [("rec_id", pa.int64()), ("first_line", pa.int64()), ("n_lines", pa.int64())])


def collapse_runs(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """One row per run or single message: its first line, user and text, the count, and the duration in seconds where lines bear times."""
    return over_records(
        tables, _collapsed, "rec_id long, first_line long, user string, text string, n_lines long, duration_s long",
        [("rec_id", pa.int64()), ("first_line", pa.int64()), ("user", pa.string()), ("text", pa.string()), ("n_lines", pa.int64()), ("duration_s", pa.int64())],
    )
