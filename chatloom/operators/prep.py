"""The prep profile: cleaned chats, topic, sentiment, quotes and a templated summary per row.

Defined cases: rows delivered twice count once; null and blank texts give no lines;
a null id reads ``row_<row_no>``; ties between one-word topics go to the shorter,
then to the earlier, between two-word topics to the longer, then to the earlier.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import rows as R
from chatloom.functions import text as T

_LINES = pa.list_(pa.struct([("pos", pa.int32()), ("line", pa.string())]))
_GRAMS = pa.list_(pa.struct([("gram", pa.string()), ("pair", pa.bool_()), ("occurrences", pa.int64()), ("pos", pa.int32()), ("i", pa.int32())]))


def _delivered(rows: DataFrame) -> DataFrame:
    return rows.select("row_no", "input_text").distinct()


def lines_of(rows: DataFrame, max_lines: int = 140) -> DataFrame:
    """(row_no, lines): the first ``max_lines`` distinct cleaned lines of each row, as an array of (pos, line)."""

    def run(row_no, text):
        yield row_no, [{"pos": p, "line": x} for p, x in R.prep_lines(text, max_lines)]

    return R.over_rows(_delivered(rows), run, "row_no long, lines array<struct<pos: int, line: string>>", [("row_no", pa.int64()), ("lines", _LINES)])


def clean_lines(rows: DataFrame, max_lines: int = 140) -> DataFrame:
    """(row_no, pos, line): the cleaned lines at their original positions."""
    return lines_of(rows, max_lines).select("row_no", F.inline("lines"))


def grams(rows: DataFrame, max_lines: int = 140) -> DataFrame:
    """(row_no, gram, pair, occurrences, pos, i): words and neighbouring word pairs without noise, with the number of lines they occur in and their first place."""

    def run(row_no, text):
        yield row_no, [g._asdict() for g in R.prep_grams(R.prep_lines(text, max_lines))]

    df = R.over_rows(_delivered(rows), run, "row_no long, grams array<struct<gram: string, pair: boolean, occurrences: long, pos: int, i: int>>", [("row_no", pa.int64()), ("grams", _GRAMS)])
    return df.select("row_no", F.inline("grams"))


def profile(rows: DataFrame, min_occurrences: int = 3, min_lines: int = 4, max_lines: int = 140, max_words: int = 12) -> DataFrame:
    """(row_no, topic, laughter, confusion, positive, negative, sentiment, quote_1, quote_2, lines) of rows with enough cleaned lines, ``lines`` as one text. One pass."""

    def run(row_no, text):
        lines = R.prep_lines(text, max_lines)
        if len(lines) >= min_lines:
            topic = R.prep_topic(R.prep_grams(lines), min_occurrences)
            yield row_no, topic, *R.prep_sentiment(lines), *R.prep_quotes(lines, topic, max_words), "\n".join(x for _, x in lines)

    names = ("topic", *L.PREP_SENTIMENT, "sentiment", "quote_1", "quote_2", "lines")
    kinds = [pa.string(), *[pa.int64()] * len(L.PREP_SENTIMENT), *[pa.string()] * 4]
    schema = "row_no long, " + ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds))
    return R.over_rows(_delivered(rows), run, schema, [("row_no", pa.int64()), *zip(names, kinds)])


def topics(rows: DataFrame, min_occurrences: int = 3, min_lines: int = 4) -> DataFrame:
    """(row_no, topic) of rows with enough lines."""
    return profile(rows, min_occurrences, min_lines).select("row_no", "topic")


def sentiments(rows: DataFrame, min_lines: int = 4) -> DataFrame:
    """(row_no, laughter, confusion, positive, negative, sentiment)."""
    return profile(rows, min_lines=min_lines).select("row_no", *L.PREP_SENTIMENT, "sentiment")


def quotes(rows: DataFrame, max_words: int = 12) -> DataFrame:
    """(row_no, quote_1, quote_2): the two best lines by topic words, charged words and readability; ties by position."""
    return profile(rows, max_words=max_words).select("row_no", "quote_1", "quote_2")


def hex_mod6(h: Column) -> Column:
    """A hexadecimal number modulo 6 by its digits: powers of 16 leave 4."""
    digit = F.transform(F.split(h, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    total = F.aggregate(digit, F.lit(0), lambda a, x: a + x)
    last = F.conv(F.substring(h, -1, 1), 16, 10).cast("int")
    return (4 * (total - last) + last) % 6


def summaries(rows: DataFrame, min_occurrences: int = 3, min_lines: int = 4, max_lines: int = 140) -> DataFrame:
    """(row_no, id, input_text, target_text) of rows with enough cleaned lines."""
    named = rows.select("row_no", F.coalesce("id", F.concat(F.lit("row_"), F.col("row_no"))).alias("id")).distinct()
    full = named.join(profile(rows, min_occurrences, min_lines, max_lines), "row_no")
    lead = F.element_at(F.array(*map(F.lit, L.LEADS)), hex_mod6(F.md5(F.col("id").cast("binary"))) + 1)
    lead = F.replace(F.replace(lead, F.lit("{topic}"), F.col("topic")), F.lit("{sentiment}"), F.col("sentiment"))
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in L.REASONS.items() for x in kv)), F.col("sentiment"))
    return full.select("row_no", "id", F.col("lines").alias("input_text"), F.concat(lead, F.lit(" Lines such as '"), "quote_1", F.lit("' and '"), "quote_2", F.lit("' "), reason, F.lit(".")).alias("target_text"))


def totals(rows: DataFrame, min_lines: int = 4) -> DataFrame:
    """One row: rows in, rows out, rows dropped for too few lines, and rows without a topic."""
    n_in = _delivered(rows).where(T.nonblank(F.col("input_text"))).agg(F.count("*")).scalar()
    n_out = topics(rows, min_lines=min_lines).agg(F.count("*").alias("rows_out"), F.count_if(F.col("topic") == L.NO_TOPIC).alias("fallback_topics"))
    return n_out.withColumn("rows_in", n_in).select("rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("rows_dropped"), "fallback_topics")


def label_histogram(summaries_: DataFrame, column: str) -> DataFrame:
    """(label, n): the first sentiment word of each summary."""
    label = F.regexp_extract(F.lower(F.col(column)), rf"(?U)\b({'|'.join(L.SENTIMENTS)})\b", 1)
    return summaries_.select(F.when(label == "", "none").otherwise(label).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
