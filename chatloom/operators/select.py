"""Representative lines from embeddings: rank by similarity to the centroid, skip what is too similar to a chosen one.

Defined cases: groups of at most ``max_selected`` lines are kept whole; the first
``max_lines`` of a group by id are looked at (0: all); null embeddings are left out;
ties go to the smaller id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.ranking import ranked


def centroid_scores(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, score): cosine to the group's centroid; means per dimension are aggregated before the shuffle."""
    v = vectors.where("embedding IS NOT NULL").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    mean = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-8))
    centre = centre.withColumn("n", norm(F.col("c")))
    dot = F.aggregate(F.zip_with("e", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return v.join(centre, "label").select("vec_id", "label", F.round(dot / F.col("n"), 6).alias("score"))


def hashed_embeddings(lines: DataFrame, key: str, group: str, text: str, dims: int = 256) -> DataFrame:
    """(vec_id, label, embedding) of text lines: signed word hashes of unit length, the stand-in where no model is given."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for t in batch.column(2).to_pylist():
                e = np.zeros(dims, np.float32)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    e[h % dims] += 1 if h >> 16 & 1 else -1
                out.append(e / max(float(np.linalg.norm(e)), 1e-8))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float32()))], ["vec_id", "label", "embedding"])

    return lines.select(F.col(key).cast("long"), group, text).mapInArrow(run, f"vec_id long, label {lines.schema[group].dataType.simpleString()}, embedding array<float>")


def semantic(vectors: DataFrame, max_lines: int = 320, max_selected: int = 80, threshold: float = 0.82) -> DataFrame:
    """(vec_id, label): the selected lines of each group, greedy by centroid similarity.

    The greedy choice is sequential; it runs per group on at most ``max_lines`` vectors,
    which bounds a task however large the group.
    """
    v = vectors.where("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    if max_lines > 0:
        v = ranked(v, ["label"], [F.col("vec_id")], F.expr("vec_id div 4096"), many=True).where(F.col("rank") <= max_lines).drop("rank")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        if len(pdf) <= max_selected:
            return pdf[["vec_id", "label"]]
        e = np.stack(pdf["embedding"].to_numpy()).astype(float)
        c = e.mean(0)
        order = np.argsort(-np.round(e @ (c / max(np.linalg.norm(c), 1e-8)), 6), kind="stable")
        taken: list[int] = []
        for i in order:
            if not taken or (e[taken] @ e[i]).max() < threshold:
                taken.append(int(i))
                if len(taken) >= max_selected:
                    break
        return pdf.iloc[sorted(taken)][["vec_id", "label"]]

    return v.groupBy("label").applyInPandas(choose, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}")
