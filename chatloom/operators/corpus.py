"""Training corpora from pairs of chat and summary: validation, load statistics, caps, splits, samples, health checks.

Order is by a seeded hash of the key, so sizes and caps hold and membership is
reproducible on any partitioning. Defined cases: null or blank fields make a pair
invalid; a null id has the source ``unknown``; ratios out of range raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import text as T
from chatloom.operators import contained, distill
from chatloom.operators.ranking import hash_bucket, ranked
from chatloom.session import hot_joined, stored


def valid(pairs: DataFrame) -> DataFrame:
    """(pair_id, id, chat, target) of pairs with both fields, stripped."""
    df = T.computed(pairs, "pair_id", "id", c=T.strip(F.col("chat")), target=T.strip(F.col("summary")))
    return df.where((F.length("c") > 0) & (F.length("target") > 0)).select("pair_id", "id", F.col("c").alias("chat"), "target")


def source_of(c: Column) -> Column:
    """Text before the first underscore; ``unknown`` without one."""
    return F.when(F.coalesce(c, F.lit("")).contains("_"), F.substring_index(c, "_", 1)).otherwise("unknown")


def low_info(target: Column) -> Column:
    """Filler wording, fewer than six words, or at most two distinct ones."""
    w = T.words(target)
    return F.lower(target).rlike(f"(?U){L.LOW_INFO}") | (F.size(w) < 6) | (F.size(F.array_distinct(w)) <= 2)


def prefix_key(target: Column, n: int = 4) -> Column:
    w = T.words(target)
    return F.when(F.size(w) == 0, T.strip(F.lower(target))).otherwise(F.array_join(F.slice(w, 1, max(1, n)), " "))


def seeded(seed: int, key: str = "pair_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def load_stats(pairs: DataFrame, drop_low_info: bool = True) -> DataFrame:
    """One row of counters: what was seen, dropped and kept, words and lines before and after distillation, and their averages."""
    seen = pairs.agg(F.count(F.when(F.col("chat").isNotNull() & F.col("summary").isNotNull(), 1))).scalar()
    ok = valid(pairs)
    per = stored(distill.messages(distill.pair_lines(ok)), "load-messages")
    stats = distill.counters(per).withColumnRenamed("window_id", "pair_id")
    text = distill.output_lines(per).groupBy(F.col("window_id").alias("pair_id")).agg(F.sum(T.count_words(F.col("line"))).alias("words_after"), F.count("*").alias("lines_after"))
    rows = ok.select("pair_id", T.count_words(F.col("chat")).alias("words_before"), F.size(T.split_lines(F.col("chat"))).alias("lines_before"), low_info(F.col("target")).alias("low")).join(stats, "pair_id", "left").join(text, "pair_id", "left")
    empty = F.col("words_after").isNull()
    low = ~empty & F.col("low") if drop_low_info else F.lit(False)
    kept = ~empty & ~low
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = rows.agg(
        total("words_before").alias("source_words_before"), total("lines_before").alias("source_lines_before"),
        *(total(c).alias(c) for c in ("removed_system_lines", "removed_empty_lines", "collapsed_duplicate_lines", "collapsed_duplicate_groups", "collapsed_token_flood_runs")),
        F.count_if(empty).alias("dropped_empty_source"), F.count_if(low).alias("dropped_low_info_targets"), F.count_if(kept).alias("kept_pairs"),
        total(F.when(kept, F.col("words_after"))).alias("source_words_after"), total(F.when(kept, F.col("lines_after"))).alias("source_lines_after"),
    )
    per = lambda c: F.round(F.col(c) / F.greatest("kept_pairs", F.lit(1)), 6)
    return out.withColumn("examples_seen", seen).select("*", per("source_words_after").alias("mean_words_after"), per("source_lines_after").alias("mean_lines_after"))


def capped(pairs: DataFrame, key: Column, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` pairs a key, by hash; 0 keeps all. Hot keys are ranked in buckets of the hash."""
    if most <= 0:
        return pairs
    df = pairs.withColumn("_key", key).withColumn("_h", seeded(seed))
    return ranked(df, ["_key"], [F.col("_h"), F.col("pair_id")], hash_bucket(F.col("_h"), 2), "_rank").where(F.col("_rank") <= most).drop("_key", "_h", "_rank")


def cap_by_target(pairs: DataFrame, most: int, seed: int = 42) -> DataFrame:
    return capped(pairs, F.col("target"), most, seed)


def cap_by_prefix(pairs: DataFrame, most: int, prefix_words: int = 4, seed: int = 42) -> DataFrame:
    return capped(pairs, prefix_key(F.col("target"), prefix_words), most, seed)


def duplicate_targets(pairs: DataFrame) -> DataFrame:
    """One row: distinct targets, repeated ones, and the copies beyond the first."""
    n = pairs.groupBy("target").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("targets"), F.count_if(F.col("n") > 1).alias("repeated_targets"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_targets"))


def near_duplicates(pairs: DataFrame, containment: float = 0.92) -> DataFrame:
    """(pair_id, class_id, links): per pair the class of its target, named by its least pair_id, and how many other classes say the same.

    Targets with the same set of words (or, without words, the same text but for case) are
    one class. Two classes say the same if they share ``containment`` of the smaller one's
    words, which covers a Jaccard similarity of 0.86. Only the number of such classes
    leaves a task, never the pairs. Texts are joined by sorting: their files are far smaller
    than they are in memory, so a broadcast chosen by file size would fill the driver.
    """
    w = F.array_sort(F.array_distinct(T.words(F.col("target"))))
    said = F.when(F.size("w") > 0, F.array_join("w", " ")).otherwise(F.concat(F.lit(" "), "lowered"))
    docs = stored(T.computed(pairs, "pair_id", w=w, lowered=F.lower("target")).select("pair_id", said.alias("said")), "near-texts")
    classes = stored(docs.groupBy("said").agg(F.min("pair_id").alias("class_id"), F.count("*").alias("n")), "near-classes")
    links = contained.links(classes.where(~F.col("said").startswith(" ")), containment)
    linked = stored(classes.join(links, "class_id", "left").withColumn("links", F.coalesce("links", F.lit(0))), "near-links")
    return hot_joined(docs, linked.hint("merge"), ["said"], "n", 256).select("pair_id", "class_id", "links")


def train_val(pairs: DataFrame, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``pairs`` with ``part``: the first ``int(n * ratio)`` by hash, at least one and not all, are validation."""
    if not 0 <= val_ratio < 1:
        raise ValueError("val_ratio must be in [0, 1)")
    if val_ratio == 0:
        return pairs.withColumn("part", F.lit("train"))
    n = pairs.agg(F.count("*")).scalar()
    size = F.when(F.col("_n") < 2, 0).otherwise(F.least(F.greatest(F.floor(F.col("_n") * F.lit(val_ratio)), F.lit(1)), F.col("_n") - 1))
    df = ranked(pairs.withColumn("_h", seeded(seed)).withColumn("_all", F.lit(0)), ["_all"], [F.col("_h"), F.col("pair_id")], hash_bucket(F.col("_h")), "_rank")
    return df.withColumn("_n", n).withColumn("part", F.when(F.col("_rank") <= size, "val").otherwise("train")).drop("_h", "_all", "_rank", "_n")


def stratified(pairs: DataFrame, train_ratio: float = 0.85, val_ratio: float = 0.10, seed: int = 42) -> DataFrame:
    """(pair_id, source, part): per source the first ``int(n * ratio)`` by hash train, the next ``int(n * ratio)`` validation, the rest test."""
    if train_ratio <= 0 or val_ratio <= 0 or train_ratio + val_ratio >= 1:
        raise ValueError("ratios must be positive and leave a test part")
    df = pairs.select("pair_id", source_of(F.col("id")).alias("source"), seeded(seed).alias("_h"))
    n = df.groupBy("source").agg(F.count("*").alias("_n"))
    r = ranked(df, ["source"], [F.col("_h"), F.col("pair_id")], hash_bucket(F.col("_h"), 2), "_rank").join(n, "source")
    n_train, n_val = F.floor(F.col("_n") * F.lit(train_ratio)), F.floor(F.col("_n") * F.lit(val_ratio))
    return r.select("pair_id", "source", F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test").alias("part"))


def contiguous(lines: DataFrame, start: int, size: int) -> DataFrame:
    """(window_id, line_no, raw): ``size`` lines of each window from its ``start``-th on (0-based), in order."""
    return ranked(lines, ["window_id"], [F.col("line_no")], F.expr("line_no div 4096"), many=True).where((F.col("rank") > start) & (F.col("rank") <= start + size)).drop("rank")


def opener_diversity(pairs: DataFrame, words: int = 3) -> DataFrame:
    """(opener, n): how often targets start with the same words."""
    return pairs.select(prefix_key(F.col("target"), words).alias("opener")).groupBy("opener").agg(F.count("*").alias("n"))


def system_leakage(pairs: DataFrame) -> DataFrame:
    """(source, pairs, leaking): targets per source that carry system wording."""
    hit = F.lower("target").rlike(f"(?U){L.DISTILL_SYSTEM}")
    return pairs.groupBy(source_of(F.col("id")).alias("source")).agg(F.count("*").alias("pairs"), F.count_if(hit).alias("leaking"))
