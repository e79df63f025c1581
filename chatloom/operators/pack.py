"""Packing of text into model-sized pieces, hierarchical reduction, and clean-up of summaries.

Packing is a sequential fold over one text's lines, so it runs within a row (Arrow
batches, no shuffle) with a pluggable tokenizer; the default counts white-space words.

Defined cases: null and blank texts give no chunk; a line over the budget is cut
into pieces of the budget, an item over it is truncated; reduction ends after
MAX_ROUNDS or as soon as a round no longer shrinks.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import corpus, distill, retrieval
from chatloom.session import stored

LINE = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
MAX_ROUNDS = 16


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, ids: list) -> str: ...


class Words:
    """White-space words as tokens."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)


Generator = Callable[[list[str]], list[str]]


def first_sentences(prompts: list[str], most: int = 24) -> list[str]:
    """The default generator: the first sentence of each prompt, at most ``most`` words of it."""
    return [" ".join(re.split(r"(?<=[.!?])\s+", p.strip(), maxsplit=1)[0].split()[:most]) for p in prompts]


def chunks(text: str | None, tokenizer: Tokenizer, max_source: int) -> list[str]:
    """Lines packed in order into chunks of ``max_source - 2`` tokens, one token a line break."""
    budget = max(16, max_source - 2)
    out: list[str] = []
    held: list[str] = []
    used = 0
    for line in (x for x in LINE.split(text or "") if x.strip()):
        ids = tokenizer.encode(line)
        if not ids:
            continue
        cost = len(ids) + 1
        if held and (len(ids) > budget or used + cost > budget):
            out.append("\n".join(held))
            held, used = [], 0
        if len(ids) > budget:
            out += [p for i in range(0, len(ids), budget) if (p := tokenizer.decode(ids[i : i + budget]).strip())]
        else:
            held.append(line)
            used += cost
    return out + (["\n".join(held)] if held else [])


def packed(items: list[str], tokenizer: Tokenizer, budget: int) -> list[list[str]]:
    """Items packed in order into groups within the budget; longer items are truncated."""
    groups: list[list[str]] = []
    used = 0
    for item in (x.strip() for x in items if x and x.strip()):
        ids = tokenizer.encode(item)
        if not ids:
            continue
        if len(ids) > budget:
            ids = ids[:budget]
            item = tokenizer.decode(ids).strip()
        if groups and used + len(ids) + 1 <= budget:
            groups[-1].append(item)
            used += len(ids) + 1
        else:
            groups.append([item])
            used = len(ids) + 1
    return groups


def reduced(parts: list[str], tokenizer: Tokenizer, generate: Generator, max_source: int) -> str:
    """Summaries of the chunks, packed and summarised again until one is left."""
    if not parts:
        return ""
    now = generate(parts)
    if len({s for s in now if s}) <= 1:
        return next((s for s in now if s), "")
    for _ in range(MAX_ROUNDS):
        if len(now) == 1:
            break
        groups = packed(now, tokenizer, max(32, max_source - 24))
        if not groups:
            return ""
        shrunk = len(groups) < len(now)
        now = generate([" ".join(g) for g in groups])
        if not shrunk:
            now = generate([" ".join(now)])
    return now[0]


def chunked(texts: DataFrame, key: str, text: str, max_source: int = 1024, tokenizer: Callable[[], Tokenizer] = Words) -> DataFrame:
    """(key, chunk_no, chunk, n_tokens). ``tokenizer`` is called once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer()
        for batch in it:
            rows = [(k, i + 1, c, len(tok.encode(c))) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, c in enumerate(chunks(t, tok, max_source))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32())))], [key, "chunk_no", "chunk", "n_tokens"])

    return texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, chunk_no int, chunk string, n_tokens int")


def packed_items(df: DataFrame, key: str, items: str, budget: int, tokenizer: Callable[[], Tokenizer] = Words) -> DataFrame:
    """(key, group_no, text, n_items): the items of an array column packed in order into groups within the budget, joined by blanks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer()
        for batch in it:
            rows = [(k, i + 1, " ".join(g), len(g)) for k, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, g in enumerate(packed(xs or [], tok, budget))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32())))], [key, "group_no", "text", "n_items"])

    return df.select(key, items).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, group_no int, text string, n_items int")


def summarized(texts: DataFrame, key: str, text: str, max_source: int = 1024, max_sentences: int = 2, prefix: str = "", generator: Callable[[], Generator] = lambda: first_sentences, tokenizer: Callable[[], Tokenizer] = Words) -> DataFrame:
    """(key, summary): chunks, hierarchical reduction and clean-up. ``generator`` and ``tokenizer`` are called once a task, so a model loads once per worker."""

    return timed(texts, key, text, max_source, max_sentences, prefix, generator, tokenizer).select(key, "summary")


def timed(texts: DataFrame, key: str, text: str, max_source: int = 1024, max_sentences: int = 2, prefix: str = "", generator: Callable[[], Generator] = lambda: first_sentences, tokenizer: Callable[[], Tokenizer] = Words) -> DataFrame:
    """(key, summary, chunks, latency_ms): as ``summarized``, with the number of chunks and the time of chunk summaries and reduction, without loading and chunking."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, gen = tokenizer(), generator()
        prompt = lambda ps: gen([prefix + p for p in ps]) if prefix else gen(ps)
        for batch in it:
            out, n, ms = [], [], []
            for t in batch.column(1).to_pylist():
                parts = chunks(t, tok, max_source)
                start = time.perf_counter()
                out.append(reduced(parts, tok, prompt, max_source))
                n.append(len(parts))
                ms.append(round((time.perf_counter() - start) * 1000, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32()), pa.array(ms, pa.float64())], [key, "raw", "chunks", "latency_ms"])

    raw = texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, raw string, chunks int, latency_ms double")
    return raw.select(key, clean_summary(F.col("raw"), max_sentences).alias("summary"), "chunks", "latency_ms")


def distinct_sentences(c: Column) -> Column:
    """Sentences in order without those that say the same as an earlier kept one."""
    keep = lambda kept, s: F.when(F.exists(kept, lambda p: T.similar(s, p)), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(T.sentences(c), F.array().cast("array<string>"), keep)


def clean_summary(c: Column, max_sentences: int = 2) -> Column:
    """At most ``max_sentences`` distinct sentences (0: all), joined."""
    kept = distinct_sentences(c)
    return F.array_join(F.slice(kept, 1, max_sentences) if max_sentences > 0 else kept, " ")


def clean_output(c: Column, max_sentences: int = 2) -> Column:
    """The first sentences, each closed with a full stop; repetitions and labels stay."""
    parts = F.filter(F.transform(F.split(T.squeeze(c), r"(?<=[.!?])\s+", -1), T.strip), lambda x: F.length(x) > 0)
    cut = F.slice(parts, 1, max_sentences) if max_sentences > 0 else parts
    return F.array_join(F.transform(cut, lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))), " ")


def prompt_block(c: Column, max_lines: int = 220) -> Column:
    """The first non-blank lines as bullets."""
    lines = F.transform(T.split_lines(c), T.strip)
    cut = F.slice(lines, 1, max_lines) if max_lines > 0 else lines
    return F.when(F.size(lines) == 0, "- (no usable chat lines)").otherwise(F.array_join(F.transform(cut, lambda x: F.concat(F.lit("- "), x)), "\n"))


# Our own wording around the lines of a chat.
ZERO_HEAD, ZERO_TAIL = "Condense the following live chat into one or two plain sentences of 20 to 55 words.\nName no users and no times, and stay with what the lines say.\n\nChat:\n", "\n\nSummary:"
RULES = "Write one or two sentences of 20 to 55 words.\nSay what the lines show: the subject, then the mood.\nName no users, no times and nothing from outside the chat."
FEW_HEAD, FEW_CHAT, FEW_SUMMARY, FEW_TARGET, FEW_TAIL = "Examples\n", "Chat:\n", "\nSummary:\n", "\nNow this one\nChat:\n", "\nSummary:"


def zero_prompt(c: Column, max_lines: int = 220) -> Column:
    """An instruction, the lines, and the place for the answer."""
    return F.concat(F.lit(ZERO_HEAD), prompt_block(c, max_lines), F.lit(ZERO_TAIL))


def few_prompt(examples: Column, c: Column, rules: str = "", max_lines: int = 220, example_lines: int = 30) -> Column:
    """Rules, worked examples (array of struct(chat, summary)) and the target chat."""
    shown = F.transform(examples, lambda e: F.concat(F.lit(FEW_CHAT), prompt_block(e["chat"], example_lines), F.lit(FEW_SUMMARY), e["summary"], F.lit("\n")))
    return F.concat(F.lit(f"{rules}\n\n{FEW_HEAD}" if rules else FEW_HEAD), F.array_join(shown, "\n"), F.lit(FEW_TARGET), prompt_block(c, max_lines), F.lit(FEW_TAIL))


def few_prompts(pairs: DataFrame, asked: DataFrame, k: int = 3, rules: str = RULES, max_lines: int = 220, example_lines: int = 30, texts: DataFrame | None = None) -> DataFrame:
    """(pair_id, prompt): for every ``asked`` pair the rules, its k most similar other valid pairs as worked examples, distilled to a few lines, and its own distilled chat; ``texts`` (pair_id, text) are targets from elsewhere, distilled already."""
    pool = stored(corpus.valid(pairs), "few-pool")
    docs = pool.select(F.col("pair_id").alias("moment_id"), retrieval.tokens(F.col("chat")).alias("tokens"))
    tf = stored(retrieval.term_counts(docs), "few-terms")
    weights = stored(retrieval.idf(docs, tf), "few-idf")
    own = distill.texts(distill.pair_lines(pool.join(asked.select("pair_id").distinct(), "pair_id", "left_semi"))) if texts is None else texts.select(F.col("pair_id").alias("window_id"), "text")
    target = stored(own, "few-targets").withColumnRenamed("window_id", "moment_id")
    wanted = retrieval.vectors(retrieval.term_counts(target.select("moment_id", retrieval.tokens(F.col("text")).alias("tokens"))), weights)
    near = stored(retrieval.nearest(wanted, retrieval.vectors(tf, weights), k, target, docs), "few-nearest")
    used = pool.join(near.select(F.col("example_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    short = distill.texts(distill.pair_lines(used), distill.DistillOptions(max_messages=example_lines)).withColumnRenamed("window_id", "pair_id")
    shown = used.select("pair_id", F.col("target").alias("summary")).join(short, "pair_id", "left").select(F.col("pair_id").alias("example_id"), F.coalesce("text", F.lit("")).alias("chat"), "summary")
    examples = near.join(shown, "example_id").groupBy("moment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chat", "summary"))), lambda x: F.struct(x["chat"].alias("chat"), x["summary"].alias("summary"))).alias("examples"))
    return target.join(examples, "moment_id").select(F.col("moment_id").alias("pair_id"), few_prompt(F.col("examples"), F.col("text"), rules, max_lines, example_lines).alias("prompt"))
