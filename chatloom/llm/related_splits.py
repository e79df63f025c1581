"""Splits that keep tied records together.

Records name a channel and a stream session in their id. Channels that share a
session or an owner are tied, also through others; all records of a component get
the same split. Components come from distributed min-label propagation with
pointer jumping over star edges (one edge per channel and session, never all pairs
of a session), splits from component swap search.

Defined cases: null ids and ids not of the form ``Source_session_window`` tie
nothing (rows with the same id still share a split, null ids are on their own);
rows without any id share one; sources unknown to ``channels`` tie nothing; null or blank owners tie nothing;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import hot_joined, small, stored

ID_FORM = r"(?iU)^(.+)_(s[0-9a-f]{8})_(\d+)\s*$"
#: Components above this share of all records are annealed first, whole in every restart: there are at most 1 / LARGE of them.
LARGE = 0.001
#: Components annealed together in one task.
BLOCK = 4096


def name_key(c):
    """A channel name without case, spaces, ``-`` and ``_``; '' for null."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-_]+", ""))


def record_keys(pairs: DataFrame) -> DataFrame:
    """pair_id, id, source_key, session of each record; the last two are null where the id isn't of the form."""
    ok = F.col("id").rlike(ID_FORM)
    return pairs.select(
        "pair_id",
        "id",
        F.when(ok, name_key(F.regexp_extract("id", ID_FORM, 1))).alias("source_key"),
        F.when(ok, F.lower(F.regexp_extract("id", ID_FORM, 2))).alias("session"),
    )


def channel_edges(keys: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channels with records, star edges a -> b). Records are reduced to distinct (source, session) before any join."""
    named = channels.select("channel_id", name_key(F.col("source")).alias("source_key"), F.lower(F.regexp_replace("owner", r"(?U)\s+", "")).alias("owner_key"))
    used = stored(keys.where("source_key IS NOT NULL").select("source_key", "session").distinct().join(named, "source_key"), "p2-used")
    with_records = used.select("channel_id", "owner_key").distinct()

    def star(df: DataFrame, key: str) -> DataFrame:
        df = df.select("channel_id", key).distinct()
        hub = stored(df.groupBy(key).agg(F.min("channel_id").alias("hub"), F.count("*").alias("n")), "p2-hubs")
        return hot_joined(df, hub, [key], "n", 64).where("channel_id <> hub").select(F.col("channel_id").alias("a"), F.col("hub").alias("b"))

    edges = star(used, "session").union(star(with_records.where("owner_key <> ''"), "owner_key")).distinct()
    return with_records.select("channel_id"), edges


def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(channel_id, component): the least node that each node reaches. Rounds grow with the logarithm of the longest path."""
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p2-edges")
    labels = stored(nodes.select(F.col("channel_id").alias("n"), F.col("channel_id").alias("l")), "p2-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("n").alias("b"), "l"), "b").groupBy(F.col("a").alias("n")).agg(F.min("l").alias("m"))
        low = labels.join(near, "n", "left").select("n", "l", F.least("l", F.coalesce("m", "l")).alias("new"))
        hop = low.alias("x").join(labels.select(F.col("n").alias("new"), F.col("l").alias("far")), "new", "left")
        nxt = stored(hop.select("n", "l", F.least("new", F.coalesce("far", "new")).alias("new")), "p2-labels")
        changed = nxt.where("l <> new").limit(1).count()
        labels = nxt.select("n", F.col("new").alias("l"))
        if not changed:
            return labels.select(F.col("n").alias("channel_id"), F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def channel_components(pairs: DataFrame, channels: DataFrame) -> DataFrame:
    nodes, edges = channel_edges(record_keys(pairs), channels)
    return connected(nodes, edges)


def tied_channels(pairs: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_a, channel_b): all pairs of channels with records that share a component, smaller first."""
    c = stored(channel_components(pairs, channels), "p2-components")
    a, b = c.select(F.col("channel_id").alias("channel_a"), "component"), c.select(F.col("channel_id").alias("channel_b"), "component")
    return a.join(b, "component").where("channel_a < channel_b").select("channel_a", "channel_b")


def anneal(n: np.ndarray, m: np.ndarray, goal: np.ndarray, goal_m: np.ndarray, start: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Best (cost, assignment) met while moving and exchanging whole components of ``n`` records, ``m`` of them labelled, between splits.

    Cost: squared deviation of each split's size from its share ``goal``, and a quarter of
    that of its labelled and of its other records from ``goal_m`` and the rest, relative to
    the total.
    """
    rng = np.random.default_rng(seed)
    k, total = len(goal), max(1.0, float(n.sum()))
    size, lab = (n / total).tolist(), (m / total).tolist()
    want, want_m = (goal * n.sum() / total).tolist(), (goal_m * m.sum() / total).tolist()
    at = start.tolist()
    over, over_m = [-x for x in want], [-x for x in want_m]
    for i, s in enumerate(at):
        over[s] += size[i]
        over_m[s] += lab[i]

    def part(s: int, dn: float = 0.0, dm: float = 0.0) -> float:
        a, b = over[s] + dn, over_m[s] + dm
        return a * a + 0.25 * (b * b + (a - b) * (a - b))

    now = sum(part(s) for s in range(k))
    best, kept = now, list(at)
    heat = max(now, 1e-9)
    first, second, to = (rng.integers(0, x, steps).tolist() for x in (len(size), len(size), k))
    swap, chance = (rng.random(steps) < 0.5).tolist(), rng.random(steps).tolist()
    cool = 1e-6 ** (1 / max(steps, 1))
    for step in range(steps):
        heat *= cool
        i, j = first[step], second[step]
        x = at[i]
        y = at[j] if swap[step] else to[step]
        if x == y:
            continue
        dn, dm = (size[i] - size[j], lab[i] - lab[j]) if swap[step] else (size[i], lab[i])
        change = part(x, -dn, -dm) + part(y, dn, dm) - part(x) - part(y)
        if change <= 0 or chance[step] < math.exp(max(-700.0, -change / heat)):
            at[i] = y
            if swap[step]:
                at[j] = x
            for s, sign in ((x, -1), (y, 1)):
                over[s] += sign * dn
                over_m[s] += sign * dm
            now += change
            if now < best - 1e-15:
                best, kept = now, list(at)
    return best, np.array(kept)


def hashed_start(component: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """A split for each component by its hash, in the proportions of ``goal``."""
    u = (pd.util.hash_array(component) >> np.uint64(11)).astype(float) / 2.0**53
    return np.minimum(np.searchsorted(np.cumsum(goal), u, side="right"), len(goal) - 1)


def largest_first(sizes: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Components by falling size, each to the split that lacks most."""
    at, lack = np.zeros(len(sizes), int), want.copy()
    for i in np.argsort(-sizes, kind="stable"):
        at[i] = int(np.argmax(lack))
        lack[at[i]] -= sizes[i]
    return at


def assign_splits(pairs: DataFrame, channels: DataFrame, proportions: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42, restarts: int = 4, steps: int = 4000, moves: int = 20) -> DataFrame:
    """(pair_id, component, split) of every record, all records of a component in one split.

    Hashed start, then moves and exchanges of whole components by simulated annealing of
    ``moves`` steps a component and ``steps`` at least, in parallel: the few components
    above LARGE of all records (all, if they are no more than a block) first, from the hash
    and from the largest-first placement;
    then the rest in blocks of about BLOCK components that share what the large ones leave
    of the proportions. Each restart of each block is a task of its own, and the best of a
    block is kept. The label balanced beside the size is whether a record has a usable
    summary. A component larger than the smallest split lands where it deviates least.
    """
    comp = channel_components(pairs, channels).join(channels.select("channel_id", name_key(F.col("source")).alias("source_key")), "channel_id").groupBy("source_key").agg(F.min("component").alias("channel"))
    comp = stored(comp, "p2-sources")
    tagged = pairs.select(
        "pair_id",
        "id",
        (F.length(F.trim(F.coalesce("summary", F.lit("")))) > 0).cast("int").alias("label"),
        F.when(F.col("id").rlike(ID_FORM), name_key(F.regexp_extract("id", ID_FORM, 1))).alias("source_key"),
    )
    # A source with a third of all records would be one task of a shuffled join; the sources are few, so they are broadcast once counted.
    record = tagged.join(small(comp, 64), "source_key", "left").select(
        "pair_id", "label",
        F.when(F.col("channel").isNotNull(), F.concat(F.lit("c"), F.col("channel")))
        .when(F.col("source_key").isNotNull(), F.concat(F.lit("s"), F.col("source_key")))
        .when(F.col("id").isNotNull(), F.concat(F.lit("i"), F.col("id")))
        .otherwise(F.concat(F.lit("p"), F.coalesce(F.col("pair_id").cast("string"), F.lit("")))).alias("component"),
    )
    record = stored(record, "p2-records")
    sizes = stored(record.groupBy("component").agg(F.count("*").alias("n"), F.sum("label").alias("n_label")), "p2-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n_label"), F.lit(0))).first()
    limit = 0 if total[1] <= BLOCK else max(1, int(total[0] * LARGE))  # few components are searched all at once
    share = np.array(proportions) / sum(proportions)
    searched = _searched(names, restarts, steps, moves, seed)
    big = sizes.where(F.col("n") > limit).withColumn("block", F.lit(-1).cast("long"))
    placed = stored(_best(big, restarts + 1, searched(share, share, largest=True)), "p2-large")
    at = {r["split"]: r for r in placed.join(big, "component").groupBy("split").agg(F.sum("n").alias("n"), F.sum("n_label").alias("m"), F.count("*").alias("c")).collect()}
    load, label_load = (np.array([float(at[x][c]) if x in at else 0.0 for x in names]) for c in ("n", "m"))
    want, label_want = np.maximum(share * total[0] - load, 0), np.maximum(share * total[2] - label_load, 0)
    goal, goal_m = want / max(want.sum(), 1e-9), label_want / max(label_want.sum(), 1e-9)
    blocks = max(1, math.ceil((total[1] - sum(r["c"] for r in at.values())) / BLOCK))
    rest = sizes.where(F.col("n") <= limit).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    others = _best(rest, restarts, searched(goal, goal_m, largest=False))
    # A component above the limit may hold a third of all records: they are few and looked up without a shuffle.
    large = small(placed, 64)
    out = record.join(large, "component").unionByName(record.join(large, "component", "left_anti").join(others, "component"))
    return out.select("pair_id", "component", "split")


def _searched(names: tuple[str, ...], restarts: int, steps: int, moves: int, seed: int):
    """Makes the search of one restart of one block, towards given shares of records and of labels."""

    def towards(goal: np.ndarray, goal_m: np.ndarray, largest: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("component")
            n, m, component = pdf["n"].to_numpy(float), pdf["n_label"].to_numpy(float), pdf["component"].to_numpy(object)
            r = int(pdf["r"].iloc[0])
            start = largest_first(n, goal * n.sum()) if largest and r == restarts else hashed_start(component, goal)
            cost, at = anneal(n, m, goal, goal_m, start, seed + r, max(steps, moves * len(n)))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "r": [r], "cost": [cost], "component": [component.tolist()], "split": [[names[i] for i in at]]})

        return run

    return towards


def _best(components: DataFrame, restarts: int, search) -> DataFrame:
    """(component, split) by the best restart of each block."""
    each = components.withColumn("r", F.explode(F.array(*map(F.lit, range(restarts)))))
    runs = each.groupBy("block", "r").applyInPandas(search, "block long, r int, cost double, component array<string>, split array<string>")
    best = runs.groupBy("block").agg(F.min_by(F.struct("component", "split"), F.struct("cost", "r")).alias("b"))
    return best.select(F.explode(F.arrays_zip("b.component", "b.split")).alias("x")).select("x.component", "x.split")
