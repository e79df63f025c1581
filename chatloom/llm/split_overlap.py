"""The same or nearly the same records across splits.

Records with the same bag of words form a class; only one record a class goes on.
A class is its bag: the set of (word, how often it came before), in one order for
all, the rarest first. Two bags that share SIMILARITY of the longer one share one of
their first len - ceil(SIMILARITY * len) + 1 tokens, so these prefixes of evaluation
classes are partitioned by token and those of training classes are scanned for hits.
A hit is the first token in common of a true pair, or none: so it goes on only if
lengths, its positions, and the parities of what stands behind it in both bags leave
SIMILARITY possible, and then the parities of the whole bags. Up to here tokens are
32-bit hashes, whose collisions can only add candidates; the few that are left are read
again and their bags intersected exactly. No filter drops a case. What is shuffled follows the corpus; the hits of
common tokens, which are only looked at, grow faster.

Defined cases: null and blank chats and chats without words make no case; null
splits are neither training nor evaluation; records without pair_id can't be named and
make no case; extra columns are ignored; an empty table
has no case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.lines import NOT_ALNUM, lines_of, parse_line
from chatloom.llm.related_splits import ID_FORM, name_key
from chatloom.session import hot_joined, keep, scratch, small, stored

#: SIMILARITY in whole numbers, so that no rounding decides a case.
PART, WHOLE = 4, 5
SIMILARITY = PART / WHOLE
#: Tokens whose counts order the prefixes; the rest, rarer ones, come first by hash. A bound changes the work, not the result.
RANKED = 1 << 18
#: Classes with one token that a task is to look at; a token of more is split over several.
HOT = 200_000
#: Longs of the parities of a whole bag.
LONGS = 6
#: Hashes of words kept by a worker.
WORDS_KEPT = 500_000


def words_of(chat: str | None) -> list[str]:
    """Words of the message texts, without case and punctuation."""
    return NOT_ALNUM.sub(" ", "\n".join(parse_line(raw)[2] for raw in lines_of(chat)).casefold()).split()


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def bags(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct hashes of (word, how often it came before in its row): their intersection is that of the multisets. Rows stay in order."""
    by = np.lexsort((h, row))
    s, r = h[by], row[by]
    start = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])] if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(start, at, 0))
    with np.errstate(over="ignore"):
        return s * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def parities_behind(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each token of rows that end at ``ends``: for each of 128 bits, whether an odd number of the row's later tokens falls on it.

    Two sets of tokens differ in at least as many tokens as these in bits.
    """
    bit = mix(tokens) & np.uint64(127)
    out = []
    for half in (0, 1):
        one = np.where(bit >> np.uint64(6) == half, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        through = np.bitwise_xor.accumulate(one) if len(one) else one
        out.append((np.repeat(through[ends - 1], np.diff(ends, prepend=0)) ^ through).view(np.int64))
    return out[0], out[1]


def parities(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LONGS longs for each row that starts at ``starts``: for each bit, whether an odd number of its tokens falls on it."""
    bit = mix(tokens) % np.uint64(64 * LONGS)
    one, at = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(at == k, one, np.uint64(0)), starts) for k in range(LONGS)], 1).view(np.int64) if len(starts) else np.empty((0, LONGS), np.int64)


def _sketches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in it:
        keys, train, words, n = [], [], [], []
        for key, split, chat in zip(*(batch.column(i).to_pylist() for i in range(3))):
            w = words_of(chat)
            if w:
                keys.append(key)
                train.append(split == "train")
                words += w
                n.append(len(w))
        ends = np.cumsum(np.array(n, np.int64))
        b = bags(word_hashes(words, known), np.repeat(np.arange(len(n)), n))
        starts = ends - n
        with np.errstate(over="ignore"):
            sums = [np.add.reduceat(x, starts) if len(n) else x for x in (mix(b), mix(b ^ np.uint64(0xD6E8FEB86659FD93)))]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(mix(b).astype(np.uint32).view(np.int32)))
        signs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * LONGS), pa.array(parities(b, starts).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(train, pa.bool_()), *(pa.array(x.view(np.int64), pa.int64()) for x in sums), lists, signs], ["pair_id", "train", "f1", "f2", "bag", "signs"])


def _bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in it:
        out = []
        for chat in batch.column(1).to_pylist():
            h = word_hashes(words_of(chat), known)
            out.append(bags(h, np.zeros(len(h), np.int64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["pair_id", "bag"])


def postings(b: np.ndarray, ends: np.ndarray, ranked: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position, token, its rank, two longs of parities behind it) for the tokens in the prefixes of the bags that end at ``ends``; ``rank`` grows with the count of the tokens ``ranked``, which are sorted, and is -1 for others."""
    n = np.diff(ends, prepend=0)
    row = np.repeat(np.arange(len(n)), n)
    if len(ranked):
        i = np.minimum(np.searchsorted(ranked, b), len(ranked) - 1)
        of = np.where(ranked[i] == b, rank[i], -1)
    else:
        of = np.full(len(b), -1)
    by = np.lexsort((b, of, row))
    tokens, of = b[by], of[by]
    s0, s1 = parities_behind(tokens.astype(np.uint64), ends)
    position = np.arange(len(b)) - np.repeat(ends - n, n)
    head = position < np.repeat(n - -(-PART * n // WHOLE) + 1, n)
    return row[head], position[head], tokens[head], of[head], s0[head], s1[head]


def _postings(ranked: np.ndarray, rank: np.ndarray, parts: np.ndarray, scanned: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of (id, bag): the token, and in one long (a row less wide) how many tokens of the bag start with it and how many must be shared.

    ``parts`` says over how many parts the classes with the token of a rank are split: a
    scanned class goes to one of them, the others to all.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            row, position, token, of, s0, s1 = postings(lists.flatten().to_numpy(), np.cumsum(n), ranked, rank)
            many = np.where(of >= 0, parts[of], 1) if len(parts) else np.ones(len(row), np.int64)
            part = ids[row] % many if scanned else np.zeros(len(row), np.int64)
            if not scanned and (many > 1).any():
                again = np.repeat(np.arange(len(row)), many)
                part = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                row, position, token, s0, s1 = (x[again] for x in (row, position, token, s0, s1))
            out = [ids[row], (part.astype(np.int64) << 32) + token, ((n[row] - position).astype(np.int64) << 32) + -(-PART * n[row].astype(np.int64) // WHOLE), s0, s1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "token", "room", "s0", "s1"])

    return run


def overlap_classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: pair_id, train, rep), (links: eval_rep, train_rep, similarity) between records and between class representatives."""
    with scratch(pairs.sparkSession):
        members, links = _linked(pairs)
        return keep(members), keep(links)


def _linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    src = pairs.where("pair_id IS NOT NULL AND chat IS NOT NULL AND split IN ('train', 'val', 'test')")
    sketches = stored(src.select("pair_id", "split", "chat").mapInArrow(_sketches, "pair_id long, train boolean, f1 long, f2 long, bag array<int>, signs array<long>"), "p6-sketches")
    slim = sketches.select("pair_id", "train", "f1", "f2")
    groups = slim.groupBy("f1", "f2").agg(F.min("pair_id").alias("rep"), F.count("*").alias("n"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval"))
    groups = stored(groups.where("n > 1"), "p6-groups")
    copied = stored(hot_joined(slim, groups, ["f1", "f2"], "n", 40).select("pair_id", "train", "rep", "in_train", "in_eval"), "p6-copied")
    copies = copied.count()
    # One pass over the sketches tells representatives: a record is its class unless it is among the copied ones.
    flags = small(copied.select("pair_id", "rep", "in_train", "in_eval"), 24, copies)
    reps = sketches.join(flags, "pair_id", "left").where("rep IS NULL OR rep = pair_id")
    reps = reps.select("pair_id", "bag", F.coalesce("in_train", "train").alias("in_train"), F.coalesce("in_eval", ~F.col("train")).alias("in_eval"))
    counts = sketches.select(F.explode("bag").alias("token")).groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(RANKED).toPandas()
    ranked = counts["token"].to_numpy(np.int32)
    order = np.argsort(ranked)
    rank = len(ranked) - 1 - order
    parts = (1 + counts["count"].to_numpy(np.int64) // HOT)[::-1].copy()
    head = "id long, token long, room long, s0 long, s1 long"
    ev = reps.where("in_eval").select("pair_id", "bag").mapInArrow(_postings(ranked[order], rank, parts, False), head).alias("e")
    tr = reps.where("in_train").select("pair_id", "bag").mapInArrow(_postings(ranked[order], rank, parts, True), head).alias("t")
    left, need = (lambda x: f"shiftright({x}.room, 32)"), (lambda x: f"({x}.room & 4294967295)")
    hit = f"e.token = t.token AND {left('e')} >= {need('t')} AND {left('t')} >= {need('e')} AND bit_count(e.s0 ^ t.s0) + bit_count(e.s1 ^ t.s1) <= {left('e')} + {left('t')} - 2 * greatest({need('e')}, {need('t')}) AND e.id <> t.id"
    hits = ev.join(tr, F.expr(hit)).select(F.col("e.id").alias("e"), F.col("t.id").alias("t")).distinct()
    signs = sketches.select("pair_id", F.size("bag").alias("n"), "signs")
    odd = " + ".join(f"bit_count(es[{k}] ^ ts[{k}])" for k in range(LONGS))
    candidates = (
        hits.join(signs.select(F.col("pair_id").alias("e"), F.col("n").alias("en"), F.col("signs").alias("es")), "e")
        .join(signs.select(F.col("pair_id").alias("t"), F.col("n").alias("tn"), F.col("signs").alias("ts")), "t")
        .where(f"{odd} <= en + tn - 2 * (({PART} * greatest(en, tn) + {WHOLE - 1}) div {WHOLE})")
    )
    candidates = stored(candidates.select("e", "t"), "p6-candidates")
    ids = stored(candidates.select(F.explode(F.array("e", "t")).alias("pair_id")).distinct(), "p6-read-again")
    bags_of = stored(src.join(small(ids, 8), "pair_id", "left_semi").select("pair_id", "chat").mapInArrow(_bags, "pair_id long, bag array<long>"), "p6-bags")
    links = (
        candidates.join(bags_of.select(F.col("pair_id").alias("e"), F.col("bag").alias("eb")), "e")
        .join(bags_of.select(F.col("pair_id").alias("t"), F.col("bag").alias("tb")), "t")
        .select("e", "t", F.size(F.array_intersect("eb", "tb")).alias("both"), F.greatest(F.size("eb"), F.size("tb")).alias("longer"))
        .where(f"{WHOLE} * both >= {PART} * longer")
        .select("e", "t", (F.col("both") / F.col("longer")).alias("similarity"))
    )
    same = copied.where("pair_id = rep AND in_eval AND in_train").select(F.col("pair_id").alias("e"), F.col("pair_id").alias("t"), F.lit(1.0).alias("similarity"))
    members = copied.select("pair_id", "train", "rep").union(slim.join(small(copied.select("pair_id"), 8, copies), "pair_id", "left_anti").select("pair_id", "train", F.col("pair_id").alias("rep")))
    return stored(members, "p6-members"), stored(links.union(same), "p6-links")


def overlap_rows(pairs: DataFrame) -> DataFrame:
    """(eval_id, train_id, similarity): every evaluation record with every training record that it shares SIMILARITY of the longer one's words with."""
    members, links = overlap_classes(pairs)
    ev = members.where("NOT train").select(F.col("pair_id").alias("eval_id"), F.col("rep").alias("e"))
    tr = members.where("train").select(F.col("pair_id").alias("train_id"), F.col("rep").alias("t"))
    return links.join(ev, "e").join(tr, "t").select("eval_id", "train_id", "similarity")


def overlap_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_a, pair_b), smaller first."""
    return overlap_rows(pairs).select(F.least("eval_id", "train_id").alias("pair_a"), F.greatest("eval_id", "train_id").alias("pair_b"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation records: how many there are, how many occur again in training, and in how many pairs."""
    hit = overlap_rows(pairs).groupBy(F.col("eval_id").alias("pair_id")).agg(F.count("*").alias("pairs"))
    source = F.when(F.col("id").rlike(ID_FORM), name_key(F.regexp_extract("id", ID_FORM, 1))).otherwise("unknown")
    ev = pairs.where("split IN ('val', 'test')").select("pair_id", "split", source.alias("source"))
    return ev.join(hit, "pair_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
