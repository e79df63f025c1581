"""Live distillation with Structured Streaming.

Parsing, filtering, normalising and flood compression are the batch expressions, run
unchanged on a stream; redelivered lines are dropped within the watermark; repeated
messages are counted per event-time window in append mode, so state is bounded by
the watermark. Lines without a time can't be placed and are left out. Windows later
than the last watermark stay open until later lines arrive, or until the end of a log
that is said to be closed.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.distill import DistillOptions, cleaned
from chatloom.session import shared_dir


def live_lines(stream: DataFrame, delay: str = "10 minutes", opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, line_no, sent_at, payload, key): kept lines, each delivered once."""
    once = stream.where("sent_at IS NOT NULL AND raw IS NOT NULL").withColumn("sent_at", F.col("sent_at").cast("timestamp")).withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["window_id", "line_no"])
    return cleaned(once, opts, keep=("sent_at",)).where("status = 'kept'").select("window_id", "line_no", "sent_at", "payload", "key")


def live_counts(stream: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", opts: DistillOptions = DistillOptions()) -> DataFrame:
    """(window_id, start, key, n): messages per event-time window, each window once it is complete."""
    lines = live_lines(stream, delay, opts)
    return lines.groupBy(F.window("sent_at", width).alias("w"), "window_id", "key").agg(F.count("*").alias("n")).select("window_id", F.col("w.start").alias("start"), "key", "n")


def run_once(spark: SparkSession, stream: DataFrame, schema: str, name: str) -> DataFrame:
    """Run a stream over what is there now into files of the shared folder and read them back."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def log_stream(spark: SparkSession, directory: str, closed: bool = False) -> DataFrame:
    """The chat log as a file stream. ``closed``: nothing will follow, so a blank line of the far future comes with it and lets every window complete; for one run over all there is."""
    schema = spark.read.parquet(f"{directory}/chat_log.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{directory}/chat_log.parque[t]")
    if not closed:
        return stream
    path = f"{shared_dir(spark)}/live-end-{uuid.uuid4().hex}"
    last = {"window_id": "", "line_no": -1, "raw": "", "sent_at": dt.datetime(9000, 1, 1)}
    spark.createDataFrame([tuple(last.get(c) for c in schema.names)], schema).write.parquet(path)
    return stream.union(spark.readStream.schema(schema).parquet(path))
