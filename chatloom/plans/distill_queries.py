"""Distillation of the chat log: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import text as T
from chatloom.operators import distill
from chatloom.plans import sqlparts as S
from chatloom.session import table
from chatloom.streaming import live


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return distill.delivered(table(spark, d, "chat_log"))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    return distill.cleaned(_lines(s, d))


def _live(s: SparkSession, d: str) -> DataFrame:
    counts = live.run_once(s, live.live_counts(live.log_stream(s, d, closed=True)), "window_id string, start timestamp, key string, n long", "live")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {
    "live_key_counts": _live,
    "parse_lines": lambda s, d: _lines(s, d).select("window_id", "line_no", T.parsed(F.col("raw")).alias("p")).select("window_id", "line_no", F.col("p.user").alias("user_name"), F.col("p.text").alias("message")),
    "system_filter_counts": lambda s, d: _cleaned(s, d).groupBy("window_id").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "system").alias("system_lines")),
    "normalize_messages": lambda s, d: _lines(s, d).select("window_id", "line_no", T.normalized(T.badge_free(T.parsed(F.col("raw"))["text"])).alias("payload")),
    "token_flood": lambda s, d: _cleaned(s, d).where("runs > 0").select("window_id", "line_no", "payload", F.col("runs").cast("long").alias("runs")),
    "dedup_key_counts": lambda s, d: distill.key_counts(distill.messages(_lines(s, d))),
    "distill_stats": lambda s, d: distill.stats(_lines(s, d)),
    "distilled_lines": lambda s, d: distill.distilled(_lines(s, d)),
    "distilled_top": lambda s, d: distill.distilled(_lines(s, d), distill.DistillOptions(max_messages=20)),
    "distilled_pairs": lambda s, d: distill.texts(distill.pair_lines(table(s, d, "summary_pairs"))).select(F.col("window_id").alias("pair_id"), F.col("text").alias("distilled")),
}

_C = S.cleaned(S.delivered())
_OUT = S.distilled(S.delivered())
_timed = "SELECT window_id, line_no, min(raw) AS raw, min(sent_at) AS sent_at FROM chat_log WHERE sent_at IS NOT NULL AND raw IS NOT NULL GROUP BY window_id, line_no"
ORACLES = {
    "live_key_counts": f"SELECT window_id, time_bucket(INTERVAL 5 MINUTES, sent_at) AS start, key, count(*) AS n FROM ({S.cleaned(_timed)}) JOIN (SELECT window_id, line_no, sent_at FROM ({_timed})) USING (window_id, line_no) WHERE status = 'kept' GROUP BY ALL",
    "parse_lines": f"SELECT window_id, line_no, usr AS user_name, txt AS message FROM ({S.parsed(S.delivered())})",
    "system_filter_counts": f"SELECT window_id, count(*) AS lines, count(*) FILTER (status = 'system') AS system_lines FROM ({_C}) GROUP BY window_id",
    "normalize_messages": f"SELECT window_id, line_no, {S.normalized(S.badge_free('txt'))} AS payload FROM ({S.parsed(S.delivered())})",
    "token_flood": f"SELECT window_id, line_no, payload, runs FROM ({_C}) WHERE runs > 0",
    "dedup_key_counts": S.key_counts(S.delivered()),
    "distill_stats": f"""SELECT window_id, sum(n)::BIGINT AS input_lines, sum(CASE WHEN status <> 'kept' THEN 0 WHEN n >= 3 THEN 1 ELSE n END)::BIGINT AS output_lines,
        sum(CASE WHEN status = 'empty' THEN n ELSE 0 END)::BIGINT AS removed_empty_lines, sum(CASE WHEN status = 'system' THEN n ELSE 0 END)::BIGINT AS removed_system_lines,
        sum(CASE WHEN status = 'kept' AND n >= 3 THEN n - 1 ELSE 0 END)::BIGINT AS collapsed_duplicate_lines, count(*) FILTER (status = 'kept' AND n >= 3) AS collapsed_duplicate_groups,
        sum(runs)::BIGINT AS collapsed_token_flood_runs, sum(CASE WHEN status = 'noise' THEN n ELSE 0 END)::BIGINT AS removed_noise_lines, 0::BIGINT AS truncated_lines
      FROM (SELECT window_id, status, CASE WHEN status = 'kept' THEN key END AS k, count(*) AS n, sum(runs) AS runs FROM ({_C}) GROUP BY ALL) GROUP BY window_id""",
    "distilled_lines": _OUT,
    "distilled_top": f"SELECT window_id, first_line, copy, line FROM ({_OUT}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY first_line, copy) <= 20",
    "distilled_pairs": f"SELECT window_id AS pair_id, string_agg(line, chr(10) ORDER BY first_line, copy) AS distilled FROM ({S.distilled(S.pair_lines())}) GROUP BY window_id",
}
