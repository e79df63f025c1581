"""Distillation of chat windows: parse, drop system lines, compress floods, collapse repeated messages, with full accounting.

Defined cases: null and blank lines are not counted; a line that is empty after its
user counts as system, one that is empty after cleaning as empty (as noise where the
raw line had a badge), one without ASCII letters or digits as empty while messages
are collapsed; redelivered lines (same window and number) count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from chatloom.functions import rows as R
from chatloom.functions import text as T
from chatloom.operators.ranking import ranked


@dataclass(frozen=True)
class DistillOptions:
    strip_metadata: bool = True
    drop_system_lines: bool = True
    collapse_duplicate_messages: bool = True
    duplicate_count_threshold: int = 3
    collapse_token_floods: bool = True
    token_flood_threshold: int = 4
    min_message_chars: int = 2
    max_messages: int = 0


def delivered(log: DataFrame) -> DataFrame:
    """(window_id, line_no, raw): non-blank lines, each key once."""
    return log.groupBy("window_id", "line_no").agg(F.min("raw").alias("raw")).where(T.nonblank(F.col("raw")))


def cleaned(lines: DataFrame, opts: DistillOptions = DistillOptions(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(window_id, line_no, raw, user, text, payload, status, runs, key): one row a line, status one of kept, system, noise, empty; ``keep`` names columns to carry along."""
    has = ("window_id", "line_no", "raw", *keep)
    df = lines.select(*has)
    least, flood = opts.min_message_chars, max(2, opts.token_flood_threshold) if opts.collapse_token_floods else 0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [R.distilled_line(raw or "", opts.strip_metadata, opts.drop_system_lines, least, flood) for raw in batch.column(2).to_pylist()]
            user, text, payload, status, runs = map(list, zip(*out)) if out else ([], [], [], [], [])
            if opts.collapse_duplicate_messages:
                key = [" ".join(R.KEY_WORD.findall(p.lower())) for p in payload]
                status = ["empty" if k == "" and x == "kept" else x for k, x in zip(key, status)]
            else:
                key = [str(n) for n in batch.column(1).to_pylist()]
            new = [*(pa.array(c, pa.string()) for c in (user, text, payload, status)), pa.array(runs, pa.int32()), pa.array(key, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "user", "text", "payload", "status", "runs", "key"])

    schema = StructType([*df.schema.fields, *(StructField(n, IntegerType() if n == "runs" else StringType()) for n in ("user", "text", "payload", "status", "runs", "key"))])
    return df.mapInArrow(run, schema)


def messages(lines: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, status, key, n, runs, first_line, line): lines counted per message, lines that are not kept per status; partial counts before the shuffle."""
    kept = F.col("status") == "kept"
    per = cleaned(lines, opts).groupBy("window_id", "status", F.when(kept, F.col("key")).alias("key"))
    return per.agg(F.count("*").alias("n"), F.sum("runs").alias("runs"), F.min("line_no").alias("first_line"), F.min_by("payload", "line_no").alias("line"))


def key_counts(per: DataFrame) -> DataFrame:
    """(window_id, key, n, first_line, line) of kept messages: their count and the first form of them."""
    return per.where("status = 'kept'").select("window_id", "key", "n", "first_line", "line")


def _least(opts: DistillOptions) -> int:
    return max(2, opts.duplicate_count_threshold) if opts.collapse_duplicate_messages else 1 << 60


def output_lines(per: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, first_line, copy, line) from counted messages; (first_line, copy) is their order within a window."""
    counts = key_counts(per)
    many = F.col("n") >= _least(opts)
    out = counts.select("window_id", "first_line", F.explode(F.sequence(F.lit(1), F.when(many, F.lit(1)).otherwise(F.col("n").cast("int")))).alias("copy"), F.when(many, F.concat("line", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("line")).alias("line"))
    if opts.max_messages > 0:
        out = ranked(out, ["window_id"], [F.col("first_line"), F.col("copy")], F.expr("first_line div 4096"), many=True).where(F.col("rank") <= opts.max_messages).drop("rank")
    return out


def distilled(lines: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, first_line, copy, line): the output lines of every window."""
    return output_lines(messages(lines, opts), opts)


def counters(per: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    """The nine counters of every window, from counted messages so that no window passes through one task whole."""
    kept, many = F.col("status") == "kept", (F.col("status") == "kept") & (F.col("n") >= _least(opts))
    total = lambda c, x="n": F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    out = per.groupBy("window_id").agg(
        F.sum("n").alias("input_lines"),
        (total(kept & ~many) + F.count_if(many)).alias("out"),
        total(F.col("status") == "empty").alias("removed_empty_lines"),
        total(F.col("status") == "system").alias("removed_system_lines"),
        (total(many) - F.count_if(many)).alias("collapsed_duplicate_lines"),
        F.count_if(many).alias("collapsed_duplicate_groups"),
        F.sum("runs").alias("collapsed_token_flood_runs"),
        total(F.col("status") == "noise").alias("removed_noise_lines"),
    )
    cap = F.least("out", F.lit(opts.max_messages)) if opts.max_messages > 0 else F.col("out")
    return out.select(
        "window_id", "input_lines", cap.alias("output_lines"), "removed_empty_lines", "removed_system_lines", "collapsed_duplicate_lines", "collapsed_duplicate_groups", "collapsed_token_flood_runs", "removed_noise_lines",
        (F.col("out") - cap).alias("truncated_lines"),
    )


def stats(lines: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    return counters(messages(lines, opts), opts)


def pair_lines(pairs: DataFrame, key: str = "pair_id", chat: str = "chat") -> DataFrame:
    """(window_id, line_no, raw) of chats held in one column."""
    return pairs.select(F.col(key).alias("window_id"), F.posexplode(T.split_lines(F.col(chat))).alias("p", "raw")).select("window_id", (F.col("p") + 1).cast("long").alias("line_no"), "raw")


def texts(lines: DataFrame, opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, text): the distilled lines of each window in order, joined by line feeds. For windows that fit a row, as the chats of pairs do."""
    return joined(distilled(lines, opts))


def joined(d: DataFrame) -> DataFrame:
    """(window_id, text) from output lines."""
    return d.groupBy("window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "copy", "line"))), lambda x: x["line"]), "\n").alias("text"))
