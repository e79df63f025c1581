"""Mix sources to target shares of tokens, repeating texts at most a capped number of times.

Texts are aggregated by membership pattern (the set of listed sources that hold
them), token capacity is routed from patterns to source quotas by min-cost flow
with convex costs per repetition, and documents are then selected by a seeded hash.
Only the patterns reach the driver, two numbers each: there are at most as many as
subsets of the listed sources (2^20 for 20) and as different texts. Where in its
pattern a text lies, by tokens before it in the order of the hash, is worked out in
the cluster.

Defined cases: null and empty texts and unlisted sources get no copies; copies of a
text count once for each source and pattern, represented by the least id; a target
without documents cannot be met and is reported with share 0, the others keep their
proportions; without ``total`` the mix is as large as all targets together allow, with
``CORPUS`` as large as the listed sources, and sources whose repeats run out fall
short; extra columns are ignored; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.encoding import RANKS, encode_text, encoding
from chatloom.session import small, stored

#: As ``total``: the tokens of all distinct texts of the listed sources.
CORPUS = "corpus"
#: Listed sources that fit the bits of a pattern, and cells of patterns by sources that the driver works on (8 bytes each); more are an error, not a cut.
SOURCES_MAX, CELLS_MAX = 62, 1 << 25
#: Texts of one pattern that are sorted in one task.
BUCKET = 50_000


def _fill(left: np.ndarray, amount: int) -> np.ndarray:
    """Shares of ``left`` that sum to ``amount``, from the front."""
    before = np.cumsum(left) - left
    return np.clip(amount - before, 0, left)


class Flow:
    """Min-cost flow from patterns to sources where only a pattern's supply costs anything, more for each repetition.

    The cheapest flow is a sequence of maximum flows that opens the supplies by rising
    cost. Augmenting paths run over the sources alone: a hop from one to another takes
    over what any patterns bring to the first and could bring to the second, for all
    patterns at once, so a path moves many parallel paths of the whole network.
    """

    def __init__(self, members: np.ndarray, tokens: np.ndarray, repeats: np.ndarray, quota: np.ndarray):
        self.tokens, self.quota = tokens, quota.copy()
        self.room = np.where(members, tokens[:, None] * repeats[None, :], 0)
        self.flow = np.zeros_like(self.room)
        self.spare = np.zeros_like(tokens)
        self.times = np.where(members, repeats[None, :], 0).max(1, initial=0)

    def run(self) -> int:
        for k in range(int(self.times.max(initial=0))):
            self.spare += np.where(self.times > k, self.tokens, 0)
            while self._augment():
                pass
        return int(self.flow.sum())

    def _augment(self) -> bool:
        n = len(self.quota)
        start = np.minimum(self.spare[:, None], self.room)
        come = {i: -1 for i in range(n) if start[:, i].any()}
        line = list(come)
        end = -1
        for i in line:
            if self.quota[i] > 0:
                end = i
                break
            have = self.flow[:, i] > 0
            open_to = self.room[have].any(0) if have.any() else np.zeros(n, bool)
            for j in np.flatnonzero(open_to):
                if j not in come:
                    come[int(j)] = i
                    line.append(int(j))
        if end < 0:
            return False
        path = [end]
        while come[path[-1]] >= 0:
            path.append(come[path[-1]])
        path.reverse()
        hops = [np.minimum(self.flow[:, i], self.room[:, j]) for i, j in zip(path, path[1:])]
        push = min(int(self.quota[end]), int(start[:, path[0]].sum()), *(int(h.sum()) for h in hops)) if hops else min(int(self.quota[end]), int(start[:, path[0]].sum()))
        for (i, j), left in zip(zip(path, path[1:]), hops):
            d = _fill(left, push)
            self.flow[:, i] -= d
            self.room[:, i] += d
            self.flow[:, j] += d
            self.room[:, j] -= d
        d = _fill(start[:, path[0]], push)
        self.spare -= d
        self.flow[:, path[0]] += d
        self.room[:, path[0]] -= d
        self.quota[end] -= push
        return True


def route(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[int, dict[tuple[int, str], int]]:
    """(tokens routed, {(pattern number, source): tokens}) for one total size. The k-th use of a pattern's tokens costs k - 1 a token."""
    names = sorted(shares)
    members = np.array([[s in m for s in names] for m, _ in patterns], bool).reshape(len(patterns), len(names))
    flow = Flow(members, np.array([t for _, t in patterns], np.int64), np.array([repeats[s] for s in names], np.int64), np.array([round(shares[s] * total) for s in names], np.int64))
    done = flow.run()
    return done, {(int(p), names[i]): int(flow.flow[p, i]) for p, i in zip(*np.nonzero(flow.flow))}


def largest_total(patterns: list[tuple[tuple[str, ...], int]], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total for which every quota can be filled, by bisection on the flow."""
    low, high = 0, sum(t * max((repeats[s] for s in m), default=0) for m, t in patterns)
    while high - low > max(1, high // 10000):
        mid = (low + high + 1) // 2
        if route(patterns, shares, repeats, mid)[0] >= sum(round(shares[s] * mid) for s in shares):
            low = mid
        else:
            high = mid - 1
    return low


def _hashed(path: str):
    """Hash and number of tokens of every text, in one pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in it:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([len(encode_text(t, enc)) for t in texts], pa.int64())], ["doc_id", "source", "hash", "n_tokens"])

    return run


def mixed(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 42, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix, each with how often it is to be used for its source."""
    spark = docs.sparkSession
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}
    names = sorted(want)
    if len(names) > SOURCES_MAX:
        raise ValueError(f"more than {SOURCES_MAX} listed sources")
    listed = docs.where("text <> ''").where(F.col("source").isin(names)).select("doc_id", "source", "text")
    held = listed.mapInArrow(_hashed(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, hash binary, n_tokens long")
    held = stored(held.groupBy("hash", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")), "p9-texts")
    bit = F.element_at(F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(1 << i).cast("long")))), F.col("source")) if names else F.lit(0).cast("long")
    texts = stored(held.groupBy("hash").agg(F.bit_or(bit).alias("pattern"), F.max("n_tokens").alias("n_tokens")), "p9-patterns")
    found = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).orderBy("pattern")
    found = stored(found, "p9-found")
    if found.count() * max(len(names), 1) > CELLS_MAX:
        raise ValueError("more patterns than the driver is to hold")
    found = found.orderBy("pattern").toPandas()
    patterns = [(tuple(s for i, s in enumerate(names) if m >> i & 1), int(t)) for m, t in zip(found["pattern"], found["tokens"])]
    present = {s for m, _ in patterns for s in m}
    weight = sum(want[s][0] for s in present) or 1.0
    shares = {s: want[s][0] / weight for s in present}
    repeats = {s: int(want[s][1]) for s in present}
    size = largest_total(patterns, shares, repeats) if total is None else sum(t for _, t in patterns) if total == CORPUS else total
    flows = route(patterns, shares, repeats, size)[1] if patterns else {}

    # Each (pattern, source) flow is a number of whole repetitions and a rest; rests of a pattern take adjoining ranges of the seeded hash, round and round.
    ranges: list[tuple[int, str, int, int, int]] = []
    at = dict.fromkeys(range(len(patterns)), 0)
    for p, s in sorted(flows):
        tokens = max(patterns[p][1], 1)
        whole, rest = divmod(flows[p, s], tokens)
        a, b = at[p], at[p] + rest
        ranges.append((int(found["pattern"][p]), s, whole, a, min(b, tokens)))
        if b > tokens:
            ranges.append((int(found["pattern"][p]), s, 0, 0, b - tokens))
        at[p] = b % tokens
    used = placed(texts, int(found["texts"].max()) if len(found) else 0, seed)
    wanted = spark.createDataFrame(pd.DataFrame(ranges, columns=["pattern", "source", "whole", "low", "high"]), "pattern long, source string, whole long, low long, high long")
    inside = ((F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high"))).cast("long")
    used = used.join(small(wanted, 64, len(ranges)), "pattern").withColumn("copies", F.col("whole") + inside)
    used = used.groupBy("hash", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    return held.join(used, ["hash", "source"]).select("doc_id", "source", "n_tokens", "copies")


def placed(texts: DataFrame, most: int, seed: int) -> DataFrame:
    """(hash, pattern, middle): the tokens of the text's pattern up to its own middle, in the order of the seeded hash.

    Hashes are cut into buckets of about BUCKET texts of the largest pattern; the sums
    of buckets are added up in a small table, those of texts inside one bucket.
    """
    buckets = 1 + most // BUCKET
    keyed = texts.withColumn("u", F.xxhash64("hash", F.lit(seed))).withColumn("b", F.floor(F.col("u") / F.lit(2.0**64) * buckets).cast("long"))
    sums = keyed.groupBy("pattern", "b").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("pattern", "b", (F.sum("t").over(Window.partitionBy("pattern").orderBy("b")) - F.col("t")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("pattern", "b").orderBy("u", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.withColumn("own", own).join(before, ["pattern", "b"]).select("hash", "pattern", (F.col("before") + F.col("own") - F.col("n_tokens") / 2).alias("middle"))


def shares(docs: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 42, path: str = RANKS) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, documents, most_copies) of every listed source."""
    m = stored(mixed(docs, targets, total, seed, path), "p9-mix").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    m = m.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row per listed source
    return targets.select("source", "target_share", "max_repeats").join(m, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
