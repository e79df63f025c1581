"""Queries p1 to p10 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm.lines import chat_tables
from chatloom.llm import abuse, broken_pairs, encoding, hidden_duplicates, lookalike, mixing, personal_info, related_splits, repeated_runs, split_overlap
from chatloom.session import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/mix_targets.parquet")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/abuse_labels.parquet")


def _abuse_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(chat_tables(spark, d), _labels(spark, d), {"moment_data": "file_name", "summary_pairs": "id"})


def _channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channels")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summary_pairs")


QUERIES = {
    "p1_found": lambda s, d: broken_pairs.broken(_pairs(s, d)),
    "p1_labels": lambda s, d: broken_pairs.labelled(_pairs(s, d)),
    "p2_found": lambda s, d: related_splits.tied_channels(_pairs(s, d), _channels(s, d)),
    "p2_components": lambda s, d: related_splits.channel_components(_pairs(s, d), _channels(s, d)),
    "p2_splits": lambda s, d: related_splits.assign_splits(_pairs(s, d), _channels(s, d)),
    "p3_found": lambda s, d: hidden_duplicates.duplicate_pairs(chat_tables(s, d)),
    "p3_collapsed": lambda s, d: hidden_duplicates.collapse(chat_tables(s, d)),
    "p4_found": lambda s, d: abuse.flagged(chat_tables(s, d), _labels(s, d)),
    "p4_scores": lambda s, d: abuse.scored(chat_tables(s, d), _labels(s, d)),
    "p4_rates": _abuse_rates,
    "p5_found": lambda s, d: repeated_runs.repeated_runs(chat_tables(s, d)),
    "p5_collapsed": lambda s, d: repeated_runs.collapse_runs(chat_tables(s, d)),
    "p6_found": lambda s, d: split_overlap.overlap_pairs(_pairs(s, d)),
    "p6_report": lambda s, d: split_overlap.overlap_report(_pairs(s, d)),
    "p7_found": lambda s, d: personal_info.personal_info(chat_tables(s, d)),
    "p7_redacted": lambda s, d: personal_info.redacted(chat_tables(s, d)),
    "p8_ids": lambda s, d: encoding.encoded(_docs(s, d)),
    "p8_decoded": lambda s, d: encoding.decoded(encoding.encoded(_docs(s, d))),
    "p9_mix": lambda s, d: mixing.mixed(_docs(s, d), _targets(s, d), mixing.CORPUS),
    "p9_shares": lambda s, d: mixing.shares(_docs(s, d), _targets(s, d), mixing.CORPUS),
    "p10_found": lambda s, d: lookalike.lookalike_pairs(_docs(s, d)),
    "p10_classes": lambda s, d: lookalike.look_classes(_docs(s, d)),
    "p10_forms": lambda s, d: lookalike.consistent(_docs(s, d)),
    "p10_folded": lambda s, d: lookalike.consistent(_docs(s, d), fold_case=True),
}

_FORM = r"(?i)^(.+)_(s[0-9a-f]{8})_([0-9]+)[\s\pZ]*$"
_key = lambda c: rf"regexp_replace(lower({c}), '[\s\pZ\-_]+', '', 'g')"
_TIES = f"""WITH RECURSIVE rec AS (SELECT {_key(f"regexp_extract(id, '{_FORM}', 1)")} AS k, lower(regexp_extract(id, '{_FORM}', 2)) AS s FROM summary_pairs WHERE regexp_matches(id, '{_FORM}')),
      u AS (SELECT DISTINCT channel_id, s, regexp_replace(lower(owner), '[\\s\\pZ]+', '', 'g') AS o FROM rec JOIN (SELECT channel_id, owner, {_key('source')} AS k FROM channels) USING (k)),
      e AS (SELECT DISTINCT x.channel_id AS a, y.channel_id AS b FROM u x JOIN u y ON x.s = y.s OR (x.o = y.o AND x.o <> '')),
      r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""
ORACLES: dict[str, str] = {
    "p2_found": f"{_TIES} SELECT DISTINCT a AS channel_a, b AS channel_b FROM r WHERE a < b",
    "p2_components": f"{_TIES} SELECT a AS channel_id, min(b) AS component FROM r GROUP BY a",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
