"""Retrieval of similar labelled moments: TF-IDF vectors, nearest examples, emotions, top terms, overlap.

Vectors are long rows (document, token, weight). A query set is scored against all
documents in blocks of BLOCK queries: each block is a bounded table of postings sent
to the executors, documents stream past it once, and every task keeps only the best
k of each query.

Defined cases: moments without text have no vector and score 0 with everybody; unknown
tokens weigh idf 1; ties go to the smaller id, also among scores of 0, so every query
gets k examples if there are as many; null structs and elements are skipped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import text as T
from chatloom.session import stored

#: Queries that are scored in one scan of the examples.
BLOCK = 4096


def tokens(c: Column) -> Column:
    return F.filter(T.words(c), lambda t: ~t.isin(L.RETRIEVAL_STOPWORDS) & (F.length(t) >= 2))


def documents(moments: DataFrame, first: int = 40) -> DataFrame:
    """(moment_id, labelled, summary, tokens): key messages twice as they are, then the texts of the first messages."""
    known = lambda c: F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull())
    keys = known(F.col("extractive_summary.key_messages"))
    text = F.array_join(F.concat(keys, keys, F.transform(F.slice(known(F.col("messages")), 1, first), T.message_text)), "\n")
    summary = F.col("abstractive_summary.summary")
    return T.computed(moments, "moment_id", labelled=T.nonblank(summary), summary=summary, tokens=tokens(text))


def term_counts(docs: DataFrame) -> DataFrame:
    return docs.select("moment_id", F.posexplode("tokens").alias("pos", "token")).groupBy("moment_id", "token").agg(F.count("*").alias("tf"), F.min("pos").alias("at"))


def idf(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """(token, df, idf) over the documents."""
    n = docs.agg(F.count("*").alias("docs")).scalar()
    return tf.groupBy("token").agg(F.count("*").alias("df")).select("token", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(tf: DataFrame, weights: DataFrame) -> DataFrame:
    """(moment_id, token, weight): log-scaled counts by idf, of unit length per document."""
    w = tf.join(weights.select("token", "idf"), "token", "left").select("moment_id", "token", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("moment_id")))  # a document's tokens fit a task
    return w.withColumn("norm", norm).select("moment_id", "token", (F.col("w") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("weight"))


def nearest(queries: DataFrame, examples: DataFrame, k: int = 3, asked: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(moment_id, example_id, score, rank): the k most similar examples of each query but itself, at least one, from long vectors; ``asked`` and ``pool`` hold the ids of all queries and examples, also of those without a vector."""
    spark, k = examples.sparkSession, max(1, k)
    packed = stored(examples.groupBy("moment_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("weight").alias("weights")), "retrieval-examples")
    ids = stored((queries if asked is None else asked).select("moment_id").distinct(), "retrieval-queries")
    n_blocks = max(1, -(-ids.count() * 5 // (4 * BLOCK)))
    ids = ids.withColumn("block", F.pmod(F.xxhash64("moment_id"), F.lit(n_blocks)))
    parts = []
    for b in range(n_blocks):
        # a block holds about BLOCK queries at most, whatever the size of the query set
        rows = queries.join(ids.where(F.col("block") == b).select("moment_id"), "moment_id", "left_semi").collect()
        names = sorted({r["moment_id"] for r in rows})
        number = {m: i for i, m in enumerate(names)}
        lists: dict[str, tuple[list[int], list[float]]] = {}
        for r in rows:
            p = lists.setdefault(r["token"], ([], []))
            p[0].append(number[r["moment_id"]])
            p[1].append(r["weight"])
        postings = spark.sparkContext.broadcast({t: (np.array(i, np.int64), np.array(w)) for t, (i, w) in lists.items()})

        def scan(it: Iterator[pa.RecordBatch], postings=postings, names=names) -> Iterator[pa.RecordBatch]:
            table = postings.value
            best: list[list[tuple[float, int]]] = [[] for _ in names]
            least = np.full(len(names), 1e-9)  # what a score must reach to be among the best k so far
            for batch in it:
                for doc, toks, ws in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    hit = [(table[t], w) for t, w in zip(toks, ws) if t in table]
                    if not hit:
                        continue
                    score = np.round(np.bincount(np.concatenate([h[0] for h, _ in hit]), np.concatenate([h[1] * w for h, w in hit]), len(names)), 9)
                    for q in np.nonzero(score >= least)[0]:
                        if names[q] != doc:
                            item = (float(score[q]), -doc)
                            if len(best[q]) < k:
                                heapq.heappush(best[q], item)
                            elif item > best[q][0]:
                                heapq.heapreplace(best[q], item)
                            if len(best[q]) == k:
                                least[q] = best[q][0][0]
            out = [(names[q], -d, s) for q, h in enumerate(best) for s, d in h]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["moment_id", "example_id", "score"])

        parts.append(packed.select("moment_id", "tokens", "weights").mapInArrow(scan, "moment_id long, example_id long, score double"))
    # With fewer than k hits the first examples by id follow with score 0; 2k + 1 of them are enough whatever the hits are.
    first = (examples if pool is None else pool).select("moment_id").distinct().orderBy("moment_id").limit(2 * k + 1).collect()
    found = ids.select("moment_id", F.explode(F.array(*(F.lit(r[0]) for r in first)).cast("array<bigint>")).alias("example_id"), F.lit(0.0).alias("score")).where("moment_id <> example_id")
    for p in parts:
        found = found.union(p)
    found = found.groupBy("moment_id", "example_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("moment_id").orderBy(F.desc("score"), "example_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def emotions(docs: DataFrame) -> DataFrame:
    """(moment_id, emotion): the lexicon with most hits, ties in listed order, ``reaction`` without any."""
    hits = lambda ws: F.size(F.filter("tokens", lambda t: t.isin(ws)))
    best = F.array_max(F.array(*(F.struct(hits(ws).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(L.EMOTIONS.items()))))
    return docs.select("moment_id", best.alias("b")).select("moment_id", F.when(F.col("b.n") > 0, F.col("b.k")).otherwise("reaction").alias("emotion"))


def top_terms(tf: DataFrame, n: int = 3) -> DataFrame:
    """(moment_id, rank, token, tf): the most frequent tokens, ties to the first seen."""
    w = Window.partitionBy("moment_id").orderBy(F.desc("tf"), "at")
    return tf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("moment_id", "rank", "token", "tf")


def overlap(docs: DataFrame, summary: str = "summary") -> DataFrame:
    """(moment_id, overlap): the share of a summary's tokens that occur in the moment, 0 without tokens."""
    own = F.array_distinct(tokens(F.coalesce(F.col(summary), F.lit(""))))
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.array_distinct("tokens"))) / F.size(own)).otherwise(0.0)
    return docs.select("moment_id", F.round(share, 6).alias("overlap"))


def coverage(docs: DataFrame) -> DataFrame:
    """One row: moments, labelled ones, their share, mean summary length and mean overlap."""
    o = docs.where("labelled").join(overlap(docs.where("labelled")), "moment_id")
    means = o.agg(F.struct(F.avg(F.length("summary")).alias("l"), F.avg("overlap").alias("o"))).scalar()
    out = docs.agg(F.count("*").alias("moments"), F.count_if("labelled").alias("labelled")).withColumn("m", means)
    mean = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("moments", "labelled", F.round(F.col("labelled") / F.greatest("moments", F.lit(1)), 6).alias("coverage"), mean("m.l").alias("mean_length"), mean("m.o").alias("mean_overlap"))


def summaries(docs: DataFrame, overwrite: bool = False) -> DataFrame:
    """(moment_id, summary): a templated sentence from the top term and the emotion, for moments without a summary or for all."""
    todo = docs if overwrite else docs.where("NOT labelled")
    top = top_terms(term_counts(todo), 1).select("moment_id", "token")
    named = lambda m, c: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), c)
    s = todo.select("moment_id").join(emotions(todo), "moment_id").join(top, "moment_id", "left").withColumn("s", named(L.EMOTION_SENTIMENT, F.col("emotion")))
    return s.select("moment_id", F.concat(F.lit("On "), F.coalesce("token", F.lit("the moment")), F.lit(" chat showed "), "s", F.lit("; repeated lines point to "), named(L.INTERPRETATIONS, F.col("s")), F.lit(".")).alias("summary"))
