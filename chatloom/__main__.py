"""Command line: ``python -m chatloom COMMAND ...``; every command reads files, runs one plan and writes a new folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators import corpus, distill, moments, pack, prep, retrieval, select
from chatloom.session import scratch, stored
from chatloom.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chatloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--input", required=True)
        c.add_argument("--output", help="a new folder; by default beside the input, with another ending")
        return c

    s = command("summarize", "distil chat logs and summarise each file")
    s.add_argument("--max-source-length", type=int, default=1024)
    s.add_argument("--max-output-sentences", type=int, default=2)
    s.add_argument("--source-prefix", default="")
    s.add_argument("--max-selected-lines", type=int, default=0, help="summarise only so many representative lines of each file (0: all)")
    s.add_argument("--max-semantic-lines", type=int, default=320)
    s.add_argument("--similarity-threshold", type=float, default=0.82)
    k = command("compare", "prompts, model summary with time, and accounting of each file as one nested document")
    k.add_argument("--pool", help="JSON lines of pairs for few-shot examples")
    k.add_argument("--pool-limit", type=int, default=0)
    k.add_argument("--few-k", type=int, default=3)
    k.add_argument("--max-source-length", type=int, default=1024)
    k.add_argument("--max-output-sentences", type=int, default=2)
    for c in (s, k, command("distill", "write the distilled lines of chat logs"), command("clean-pairs", "distil, filter and cap training pairs, with train and validation parts")):
        for flag in ("strip-metadata", "drop-system-lines", "collapse-duplicate-messages", "collapse-token-floods"):
            c.add_argument(f"--{flag}", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--duplicate-count-threshold", type=int, default=3)
        c.add_argument("--token-flood-threshold", type=int, default=4)
        c.add_argument("--min-message-chars", type=int, default=2)
        c.add_argument("--max-messages", type=int, default=0)
    c = sub.choices["clean-pairs"]
    c.add_argument("--input-key", default="chat")
    c.add_argument("--target-key", default="summary")
    c.add_argument("--val-ratio", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--max-examples-per-target", type=int, default=0)
    c.add_argument("--max-examples-per-target-prefix", type=int, default=0)
    c.add_argument("--target-prefix-words", type=int, default=4)
    c.add_argument("--drop-low-info-targets", action=argparse.BooleanOptionalAction, default=False)
    q = command("prep", "clean chats and write templated summaries")
    q.add_argument("--topic-min-line-occ", type=int, default=3)
    q.add_argument("--min-lines", type=int, default=4)
    q.add_argument("--max-lines", type=int, default=140)
    t = command("split", "split JSON lines by source into train, val and test")
    t.add_argument("--train-ratio", type=float, default=0.85)
    t.add_argument("--val-ratio", type=float, default=0.10)
    t.add_argument("--seed", type=int, default=42)
    w = command("rewrite", "write moments with templated summaries")
    r = command("retrieve", "write the nearest labelled moments and a summary of each unlabelled one")
    r.add_argument("--k", type=int, default=3)
    r.add_argument("--overwrite", action=argparse.BooleanOptionalAction, default=False)
    for c in (w, r):
        c.add_argument("--preview", type=int, default=5, help="print so many of the summaries")
    return p


def options(a: argparse.Namespace) -> distill.DistillOptions:
    return distill.DistillOptions(**{k: v for k, v in vars(a).items() if k in distill.DistillOptions.__dataclass_fields__})


def clean_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = io.pairs(spark, a.input, a.input_key, a.target_key).select(F.col("line_no").alias("pair_id"), F.lit(None).cast("string").alias("id"), "chat", "summary")
    chats = distill.texts(distill.pair_lines(raw), options(a)).select(F.col("window_id").alias("pair_id"), F.col("text").alias("chat"))
    pairs = corpus.valid(raw.drop("chat").join(chats, "pair_id"))
    if a.drop_low_info_targets:
        pairs = pairs.where(~corpus.low_info(F.col("target")))
    parts = corpus.train_val(pairs, a.val_ratio, a.seed)
    train = corpus.cap_by_prefix(corpus.cap_by_target(parts.where("part = 'train'"), a.max_examples_per_target, a.seed), a.max_examples_per_target_prefix, a.target_prefix_words, a.seed)
    io.write_splits(train.unionByName(parts.where("part = 'val'")).select("chat", F.col("target").alias("summary"), "part"), "part", a.output)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = io.json_lines(spark, a.input).select(F.col("line_no").alias("pair_id"), F.expr("try_variant_get(v, '$.id', 'string')").alias("id"), F.to_json("v").alias("value"))
    parts = corpus.stratified(rows, a.train_ratio, a.val_ratio, a.seed)
    rows.join(parts.select("pair_id", "part"), "pair_id").select("value", "part").write.mode("error").partitionBy("part").text(a.output)


def numbered(m: DataFrame) -> DataFrame:
    """Moments with an id of their own: copies of one moment are different rows."""
    return stored(m.withColumn("moment_id", F.monotonically_increasing_id()), "cli-moments")


def shown(df: DataFrame, most: int) -> None:
    """The first summaries, shortened."""
    for r in df.orderBy("moment_id").select("window_id", moments.preview(F.col("summary")).alias("summary")).limit(most).collect():
        print(f"- {r['window_id'] or 'unknown'}: {r['summary']}")


def rewrite(spark: SparkSession, a: argparse.Namespace) -> None:
    m = numbered(io.moments(spark, a.input))
    out = stored(moments.rewritten(m), "cli-rewritten")
    io.write_json_array(out.drop("moment_id"), a.output)
    shown(out.withColumn("summary", F.col("abstractive_summary.summary")), a.preview)


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    m = numbered(io.moments(spark, a.input))
    docs = stored(retrieval.documents(m), "cli-documents")
    known = docs.where("labelled")
    weights = retrieval.idf(known, retrieval.term_counts(known))
    todo = docs if a.overwrite else docs.where("NOT labelled")
    near = retrieval.nearest(retrieval.vectors(retrieval.term_counts(todo), weights), retrieval.vectors(retrieval.term_counts(known), weights), a.k, todo, known)
    examples = near.groupBy("moment_id").agg(F.sort_array(F.collect_list(F.struct("rank", "example_id", "score"))).alias("examples"))
    out = stored(m.join(retrieval.summaries(docs, a.overwrite), "moment_id").join(examples, "moment_id", "left"), "cli-retrieved")
    io.write_json_array(out.select("file_name", "window_id", F.struct("summary").alias("abstractive_summary"), "examples"), a.output)
    shown(out, a.preview)


def summarize(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = distill.distilled(io.chat_log(spark, a.input), options(a))
    if a.max_selected_lines > 0:
        at = F.col("first_line") * (1 << 20) + F.col("copy")
        lines = stored(lines.withColumn("at", at), "cli-lines")
        kept = select.semantic(select.hashed_embeddings(lines, "at", "window_id", "line"), a.max_semantic_lines, a.max_selected_lines, a.similarity_threshold)
        lines = lines.join(kept.select(F.col("vec_id").alias("at"), F.col("label").alias("window_id")), ["window_id", "at"])
    io.write_json_lines(pack.summarized(distill.joined(lines), "window_id", "text", a.max_source_length, a.max_output_sentences, a.source_prefix), a.output)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    log = stored(io.chat_log(spark, a.input), "cli-log")
    per = stored(distill.messages(log, options(a)), "cli-messages")
    texts = stored(distill.joined(distill.output_lines(per, options(a))), "cli-texts")
    counts = distill.counters(per, options(a))
    model = pack.timed(texts, "window_id", "text", a.max_source_length, a.max_output_sentences)
    out = texts.join(counts, "window_id").join(model, "window_id").withColumn("zero_prompt", pack.zero_prompt(F.col("text")))
    if a.pool:
        pool = io.pairs(spark, a.pool, strict=False, pool_limit=a.pool_limit).select(F.col("line_no").alias("pair_id"), F.lit(None).cast("string").alias("id"), "chat", "summary")
        own = texts.select((-F.row_number().over(Window.orderBy("window_id"))).cast("long").alias("pair_id"), "window_id", "text")  # a row a file
        asked = stored(own, "cli-asked")
        prompts = pack.few_prompts(pool, asked, a.few_k, texts=asked).join(asked, "pair_id").select("window_id", F.col("prompt").alias("few_prompt"))
        out = out.join(prompts, "window_id", "left")
    stats = [c for c in counts.columns if c != "window_id"]
    doc = [F.lit(a.input).alias("in"), F.unix_timestamp().alias("ts"), F.struct(*stats).alias("clean_stats"), F.struct("chunks", "latency_ms", "summary").alias("model"), "zero_prompt", *(["few_prompt"] if a.pool else [])]
    io.write_json_array(out.select("window_id", *doc), a.output)


ENDINGS = {"distill": ".distilled", "summarize": ".summary", "clean-pairs": ".pairs", "prep": ".prep", "split": ".splits", "rewrite": "_rewritten", "retrieve": "_fewshot", "compare": "_compared"}


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.output = a.output or io.named_after(a.input, ENDINGS[a.command])
    spark = SparkSession.builder.appName(f"chatloom {a.command}").getOrCreate()
    with scratch(spark):
        if a.command == "distill":
            io.write_json_lines(distill.distilled(io.chat_log(spark, a.input), options(a)), a.output)
        elif a.command == "prep":
            io.write_json_lines(prep.summaries(io.prep_rows(spark, a.input), a.topic_min_line_occ, a.min_lines, a.max_lines).select("id", "input_text", "target_text"), a.output)
        else:
            {"summarize": summarize, "clean-pairs": clean_pairs, "split": split, "rewrite": rewrite, "retrieve": retrieve, "compare": compare}[a.command](spark, a)


if __name__ == "__main__":
    main()
