"""Sources and sinks: chat logs, JSON lines, JSON arrays of moments, and the driver's Parquet tables.

Line numbers come from a file's splits: rows are numbered inside each split and the
sizes of earlier splits are added, so a file of any size is read in parallel.
Defined cases: a missing path or a log without text raises; blank lines are skipped
and keep their numbers; strict readers raise with the number of the first bad line,
permissive ones leave bad lines out; sinks never write to the place they read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators.ranking import ranked

MOMENT = "window_id string, messages array<string>, extractive_summary struct<key_messages: array<string>>, abstractive_summary struct<summary: string>"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, raw) of every line of the text files at ``path``, counted from 1 per file."""
    df = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("raw"))
    return ranked(df, ["_file"], [F.col("_id")], F.col("_start"), "line_no").select("file_name", F.col("line_no").cast("long").alias("line_no"), "raw")


def chat_log(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, line_no, raw): text logs, one window a file; raises if there is no text."""
    df = numbered(spark, path).where(T.nonblank(F.col("raw"))).withColumnRenamed("file_name", "window_id")
    if df.isEmpty():
        raise ValueError(f"no text in {path}")
    return df


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file_name, line_no, v): one VARIANT a non-blank line. Strict: the first line that is no JSON raises with its number; else such lines are left out."""
    df = numbered(spark, path).where(T.nonblank(F.col("raw"))).withColumn("v", F.try_parse_json("raw"))
    if strict:
        bad = df.where(F.col("v").isNull()).agg(F.min("line_no")).first()[0]
        if bad is not None:
            raise ValueError(f"invalid JSON at line {bad} of {path}")
    return df.where(F.col("v").isNotNull()).select("file_name", "line_no", "v")


def _text(v: str, key: str):
    got = F.expr(f"variant_get({v}, '$.{key}', 'variant')")
    return F.when(F.expr(f"schema_of_variant(variant_get({v}, '$.{key}', 'variant')) = 'STRING'"), got.cast("string"))


def pairs(spark: SparkSession, path: str, input_key: str = "chat", target_key: str = "summary", strict: bool = True, pool_limit: int = 0) -> DataFrame:
    """(line_no, chat, summary): strict keeps string fields only, permissive turns other values into text; blank ones are left out; ``pool_limit`` keeps the first valid ones only (0: all)."""
    v = json_lines(spark, path, strict)
    field = (lambda k: _text("v", k)) if strict else (lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')"))
    df = v.select("line_no", T.strip(field(input_key)).alias("chat"), T.strip(field(target_key)).alias("summary")).where((F.length("chat") > 0) & (F.length("summary") > 0))
    if df.isEmpty():
        raise ValueError(f"no valid pairs in {path}")
    return df.orderBy("line_no").limit(pool_limit) if pool_limit > 0 else df


def prep_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, id, input_text): JSON lines in file order; a missing id reads ``row_<n>`` over the non-blank rows."""
    v = json_lines(spark, path)
    n = ranked(v.withColumn("_all", F.lit(0)), ["_all"], [F.col("line_no")], F.expr("line_no div 4096"), "row_no", many=True)
    return n.select("row_no", F.coalesce(F.expr("try_variant_get(v, '$.id', 'string')"), F.concat(F.lit("row_"), "row_no")).alias("id"), F.coalesce(F.expr("try_variant_get(v, '$.input_text', 'string')"), F.lit("")).alias("input_text"))


def moments(spark: SparkSession, path: str) -> DataFrame:
    """Moments of JSON array files, with their file's name; a root that is no array raises."""
    df = spark.read.schema(f"{MOMENT}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    if df.select("window_id", "messages", "_corrupt_record").where(F.col("_corrupt_record").isNotNull()).limit(1).collect():
        raise ValueError(f"no JSON array of moments in {path}")
    return df.drop("_corrupt_record")


def parquet(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, null fields kept, non-ASCII text as it is."""
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays of objects, one array a file, readable by ``moments``; partitions without rows give empty arrays or empty files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for batch in it:
            rows = batch.column(0).to_pylist()
            if rows:
                lines = [*([held] if held is not None else []), *rows]
                held = lines.pop()
                yield pa.RecordBatch.from_pydict({"value": pa.array([f"  {x}," for x in lines], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [*([f"  {held}"] if held is not None else []), "]"]})

    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(run, "value string").write.mode("error").text(path)


def named_after(path: str, ending: str) -> str:
    """The default place of a result: beside its source, with another ending."""
    return re.sub(r"(\.[A-Za-z0-9]+)?/*$", "", path, count=1) + ending


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("error").text(path)


def write_splits(df: DataFrame, part: str, path: str) -> None:
    """JSON lines in one folder per part."""
    df.write.mode("error").partitionBy(part).json(path)


def as_json(*columns: str):
    """One JSON document a row, for nested results."""
    return F.to_json(F.struct(*columns))


def answered(prompts: DataFrame, key: str, prompt: str, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(key, answer, error): every prompt sent through a client that is made once a task; a failing call gives a null answer and its error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in it:
            answers, errors = [], []
            for p in pdf[prompt]:
                try:
                    answers.append(ask(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever the service raises becomes data
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "answer": answers, "error": errors})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, answer string, error string")
