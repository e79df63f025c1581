"""How many other texts hold almost all words of a text, or have almost all of theirs in it: counted exactly, block against block.

No pair of texts leaves its task: pairs grow faster than texts, their counts don't. A
task holds the texts of two blocks, whose sizes are bounded in words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Words of a block of larger texts; a block of smaller ones has half of them.
BLOCK = 1 << 21
#: Smaller texts that are worth a task.
LEAST = 1024
#: Words of a smaller text that are looked up beyond those that it may miss.
MORE = 5


def links(texts: DataFrame, share: float, block: int = BLOCK) -> DataFrame:
    """(class_id, links) of those with links in a stored table (class_id, said) of distinct words joined by spaces.

    Two texts are linked if they share ``share`` of the smaller one's words, at least one,
    and their ids differ.
    """
    texts = texts.where("class_id IS NOT NULL").select("class_id", "said")
    n, words = texts.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("said", " "))), F.lit(0))).first()
    cores = texts.sparkSession.sparkContext.defaultParallelism
    large = max(1, math.ceil(words / block))
    small = max(1, math.ceil(2 * words / block), min(math.ceil(2 * cores / large), math.ceil(n / LEAST)))
    place, every = lambda k: F.pmod(F.xxhash64("said"), F.lit(k)).cast("int"), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = texts.select("*", F.lit(True).alias("smaller"), place(small).alias("a"), every(large).alias("b"))
    b = texts.select("*", F.lit(False).alias("smaller"), every(small).alias("a"), place(large).alias("b"))
    cells = a.unionByName(b).select((F.col("a") * large + F.col("b")).alias("cell"), "smaller", "class_id", "said")

    def run(cell: pa.Table) -> pa.Table:
        return _linked(cell, share)

    found = cells.repartitionById(small * large, "cell").groupBy("cell").applyInArrow(run, StructType([texts.schema["class_id"]]).add("links", LongType()))
    return found.groupBy("class_id").agg(F.sum("links").alias("links"))


def _linked(cell: pa.Table, share: float) -> pa.Table:
    """(class_id, links) of one cell: every text of ``smaller`` against every one of the others that has as many words or more.

    Of any miss + k words of a text that may miss so many, k are in a text that it is linked
    with. For its rarest ones these are few; their shares are then counted in full.
    """
    cell = cell.sort_by([("smaller", "descending")]).combine_chunks()
    ids, said = (cell[c].combine_chunks() for c in ("class_id", "said"))
    n_a = pc.sum(cell["smaller"]).as_py() or 0
    split = pc.split_pattern(said, " ")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten().dictionary_encode()
    known, words = len(words.dictionary), words.indices.to_numpy()
    code = ids.dictionary_encode().indices.to_numpy()
    starts = np.cumsum(sizes) - sizes
    a_words, b_words = np.split(words, [sizes[:n_a].sum()])
    a_start, a_size, b_start, b_size = starts[:n_a].tolist(), sizes[:n_a], starts[n_a:] - len(a_words), sizes[n_a:]

    df = np.bincount(b_words, minlength=known)
    ends = np.cumsum(df)
    holders = np.split(np.repeat(np.arange(len(b_size)), b_size)[np.argsort(b_words, kind="stable")], ends[:-1])
    a_words = a_words[np.lexsort((df[a_words], np.repeat(np.arange(n_a), a_size)))]
    need = np.maximum(np.ceil(share * a_size), 1).astype(np.int64)
    a_links, b_links = np.zeros(n_a, np.int64), np.zeros(len(b_size), np.int64)
    seen = np.zeros(len(b_size), np.min_scalar_type(int((a_size - need).max(initial=0)) + MORE))
    marked = np.zeros(known, np.uint8)
    for i, (start, size, least) in enumerate(zip(a_start, a_size.tolist(), need.tolist(), strict=True)):
        own = a_words[start : start + size]
        k = min(least, MORE)
        seen.fill(0)
        for w in own[: size - least + k].tolist():
            seen[holders[w]] += 1
        met = np.flatnonzero(seen >= k)
        met = met[b_size[met] >= size]
        if k < least and len(met):
            n = b_size[met]
            first = np.cumsum(n) - n
            at = np.repeat(b_start[met] - first, n)
            at += np.arange(len(at))
            marked[own] = 1
            met = met[np.add.reduceat(marked[b_words[at]], first, dtype=np.int64) >= least]
            marked[own] = 0
        met = met[code[n_a + met] != code[i]]
        a_links[i] = len(met)
        b_links[met[b_size[met] > size]] += 1  # texts of one size meet again the other way round
    found = np.concatenate([a_links, b_links])
    some = np.flatnonzero(found)
    return pa.table({"class_id": ids.take(pa.array(some)), "links": found[some]})
