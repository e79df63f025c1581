"""Sources and sinks: what a table is after it went through a file format and back; queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.operators import corpus, moments
from chatloom.plans import sqlparts as S
from chatloom.plans.model_queries import ORACLES as MODEL_SQL
from chatloom.plans.model_queries import VALID
from chatloom.session import shared_dir, table
from chatloom.sources import io, models


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "io-text")
    io.write_text(table(s, d, "chat_log").where("raw IS NOT NULL"), "raw", path)
    return io.chat_log(s, path).groupBy("raw").agg(F.count("*").alias("n"))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "io-numbered")
    io.write_text(table(s, d, "prep_input").coalesce(1).sortWithinPartitions("row_no", "id", "input_text").select(F.coalesce("id", F.lit("")).alias("id")), "id", path)
    return io.numbered(s, path).select("line_no", "raw")


def _pairs(strict: bool, most: int = 0):
    def query(s: SparkSession, d: str) -> DataFrame:
        path = _place(s, "io-pairs")
        io.write_json_lines(table(s, d, "summary_pairs").coalesce(1).sortWithinPartitions("pair_id").select("chat", "summary"), path)
        return io.pairs(s, path, strict=strict, pool_limit=most).select("chat", "summary")

    return query


def _rows(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "io-rows")
    io.write_json_lines(table(s, d, "prep_input").coalesce(1).sortWithinPartitions("row_no", "id", "input_text").select("id", "input_text"), path)
    return io.prep_rows(s, path)


def _moments(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "io-moments")
    io.write_json_array(table(s, d, "moment_data").select("window_id", "messages", "extractive_summary", "abstractive_summary"), path)
    return io.moments(s, path).select("window_id", F.array_join("messages", "\n").alias("said"), F.array_join("extractive_summary.key_messages", "\n").alias("key_lines"), F.col("abstractive_summary.summary").alias("summary"))


def _splits(s: SparkSession, d: str) -> DataFrame:
    path = _place(s, "io-splits")
    io.write_splits(corpus.stratified(table(s, d, "summary_pairs")), "part", path)
    return s.read.schema("pair_id long, source string, part string").json(path).select("pair_id", "source", "part")


class _Lengths:
    """A tokenizer whose ids are the lengths of words."""

    def encode(self, text: str) -> list[int]:
        return [len(w) for w in text.split()]


def _asked(s: SparkSession, d: str) -> DataFrame:
    def client():
        def ask(prompt: str) -> str:
            if len(prompt) % 7 == 0:
                raise ValueError("no answer")
            return f"{len(prompt)} signs"

        return ask

    return io.answered(corpus.valid(table(s, d, "summary_pairs")), "pair_id", "target", client)


QUERIES = {
    "text_lines": _text,
    "numbered_lines": _numbered,
    "json_pairs": _pairs(True),
    "json_pairs_permissive": _pairs(False),
    "json_pairs_pool": _pairs(False, 40),
    "json_prep_rows": _rows,
    "json_arrays": _moments,
    "json_splits": _splits,
    "client_answers": _asked,
    "training_examples": lambda s, d: models.training_examples(table(s, d, "summary_pairs"), _Lengths, max_source=32, max_target=16),
    "host_names": lambda s, d: corpus.valid(table(s, d, "summary_pairs")).select("pair_id", moments.streamerized(F.col("chat")).alias("chat")),
}

_stripped = f"SELECT pair_id, {S.strip('chat')} AS chat, {S.strip('summary')} AS summary FROM summary_pairs"
_json = f"SELECT chat, summary FROM ({_stripped}) WHERE chat <> '' AND summary <> ''"
_lens = lambda c, n, pad: f"list_concat((list_transform({S.tokens(c)}, lambda w: length(w)))[1:{n}], list_transform(range(0, greatest(0, {n} - len({S.tokens(c)}))), lambda i: {pad}))"
ORACLES = {
    "text_lines": f"SELECT raw, count(*) AS n FROM chat_log WHERE {S.strip('raw')} <> '' GROUP BY raw",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY row_no, id NULLS FIRST, input_text NULLS FIRST) AS line_no, coalesce(id, '') AS raw FROM prep_input",
    "json_pairs": _json,
    "json_pairs_permissive": _json,
    "json_pairs_pool": f"SELECT chat, summary FROM ({_stripped}) WHERE chat <> '' AND summary <> '' ORDER BY pair_id LIMIT 40",
    "json_prep_rows": "SELECT n AS row_no, coalesce(id, 'row_' || n) AS id, coalesce(input_text, '') AS input_text FROM (SELECT *, row_number() OVER (ORDER BY row_no, id NULLS FIRST, input_text NULLS FIRST) AS n FROM prep_input)",
    "json_arrays": "SELECT window_id, array_to_string(list_filter(messages, lambda x: x IS NOT NULL), chr(10)) AS said, array_to_string(list_filter(extractive_summary.key_messages, lambda x: x IS NOT NULL), chr(10)) AS key_lines, abstractive_summary.summary AS summary FROM moment_data",
    "json_splits": MODEL_SQL["stratified_split"],
    "client_answers": f"SELECT pair_id, CASE WHEN length(target) % 7 <> 0 THEN length(target) || ' signs' END AS answer, CASE WHEN length(target) % 7 = 0 THEN 'ValueError: no answer' END AS error FROM ({VALID})",
    "training_examples": f"SELECT pair_id, {_lens('chat', 32, 0)} AS input_ids, {_lens('chat', 32, 0)} AS attention, {_lens('summary', 16, models.IGNORED)} AS labels FROM summary_pairs WHERE {S.strip('chat')} <> '' AND {S.strip('summary')} <> ''".replace(
        f"{_lens('chat', 32, 0)} AS attention", f"list_transform({_lens('chat', 32, 0)}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS attention"
    ),
    "host_names": f"""SELECT pair_id, {S.sub(S.sub('chat', f'(?i){L.HOST_NAMES}', '{streamer}'), chr(92) + '{streamer' + chr(92) + '}(?:' + chr(92) + 's+' + chr(92) + '{streamer' + chr(92) + '})+', '{streamer}')} AS chat FROM ({VALID})""",
}
