import itertools
import random

import pytest

from chatloom.llm.lines import lines_of, parse_line, seconds
from chatloom.llm import hidden_duplicates as dup
from chatloom.llm import related_splits as rel
from chatloom.llm import repeated_runs as runs
from chatloom.llm import split_overlap as over


@pytest.mark.parametrize(
    "raw, want",
    [
        ("[00:01:02] ann: hi: all", ("00:01:02", "ann", "hi: all")),
        ("\tann [00:01:02]: hi", ("00:01:02", "ann", "hi")),
        ("ann: hi", (None, "ann", "hi")),
        ('{"user": "ann", "text": "hi \\u00e9", "time": "1:02:03"}', ("1:02:03", "ann", "hi é")),
        ("  text=a | b | user=ann | time=00:00:01 ", ("00:00:01", "ann", "a | b")),
        ("user=ann|time=00:00:01|text=x=y", ("00:00:01", "ann", "x=y")),
        ("look at https://a.b/c", (None, None, "look at https://a.b/c")),
        ("https://a.b/c", (None, None, "https://a.b/c")),
        ('{"broken', (None, None, '{"broken')),
        ('{"a":' * 5000 + "}", (None, None, '{"a":' * 5000 + "}")),
        ("[not a time] x", (None, None, "[not a time] x")),
    ],
)
def test_line_shapes(raw, want):
    assert parse_line(raw) == want


def test_lines_and_times():
    assert lines_of("a\n\n \n b") == ["a", " b"] and lines_of([None, "", "x"]) == ["x"] and lines_of(None) == []
    assert (seconds("0:01:02"), seconds("01:02"), seconds("x"), seconds(None)) == (62, 3720, None, None)


CHANNELS = "channel_id long, source string, owner string, rep string"
PAIRS = "pair_id long, id string, chat string, summary string, split string, band int"


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, PAIRS)


def test_ties_against_brute_force(spark):
    rng = random.Random(5)
    channels = [(i, f"Chan_{i}", rng.choice([None, " ", f"Own {i % 7}", f"own  {i % 7}"]), "x") for i in range(40)]
    rows = []
    for k in range(120):
        c = rng.randrange(45)
        name = rng.choice([f"Chan_{c}", f"CHAN {c}", f" chan-{c}"])
        rows.append((k, rng.choice([f"{name}_s{rng.randrange(60):08x}_{k}", f"{name}_S{rng.randrange(60):08X}_1 ", None, f"row_{k}"]), "c", "s", None, 1))
    got = {tuple(r) for r in rel.tied_channels(pairs_of(spark, rows), spark.createDataFrame(channels, CHANNELS)).collect()}
    boss = {}

    def root(x):
        while boss.setdefault(x, x) != x:
            x = boss[x]
        return x

    used = {}
    for _, i, *_ in rows:
        if i and "row_" not in i:
            n, s, _ = i.strip().rsplit("_", 2)
            c = int("".join(ch for ch in n if ch.isdigit()))
            if c < 40:
                used[c] = True
                boss[root(("c", c))] = root(("s", s.lower()))
    for c, _, o, _ in channels:
        if c in used and o and o.strip():
            boss[root(("c", c))] = root(("o", o.lower().replace(" ", "")))
    want = {(a, b) for a, b in itertools.combinations(sorted(used), 2) if root(("c", a)) == root(("c", b))}
    assert got == want and want


def test_splits_keep_components_and_proportions(spark, data):
    pairs, channels = spark.read.parquet(f"{data}/summary_pairs.parquet"), spark.read.parquet(f"{data}/channels.parquet")
    out = rel.assign_splits(pairs, channels)
    assert out.count() == pairs.count()
    assert out.groupBy("component").agg({"split": "min", "*": "count"}).count() == out.select("component", "split").distinct().count()
    synth = pairs_of(spark, [(i, f"x{i // 3}", "c", "s", None, 1) for i in range(3000)])
    n = {r["split"]: r["count"] for r in rel.assign_splits(synth, channels).groupBy("split").count().collect()}
    assert abs(n["train"] - 2400) <= 30 and abs(n["val"] - 300) <= 30
    assert rel.assign_splits(pairs_of(spark, []), channels).count() == 0
    assert rel.tied_channels(pairs, channels.limit(0)).count() == 0


def test_search_beats_its_starts_on_the_tables(spark):
    """All components of the driver's tables take part: size and label deviation are no worse than those of either start."""
    import numpy as np

    d = "/root/testdata/sf0.01"
    pairs, channels = spark.read.parquet(f"{d}/summary_pairs.parquet"), spark.read.parquet(f"{d}/channels.parquet")
    out = rel.assign_splits(pairs, channels).join(pairs.selectExpr("pair_id", "CAST(length(trim(coalesce(summary, ''))) > 0 AS INT) AS label"), "pair_id").toPandas()
    assert len(out) == pairs.count() and out.groupby("component")["split"].nunique().max() == 1
    c = out.groupby("component").agg(n=("pair_id", "size"), m=("label", "sum"), split=("split", "first")).reset_index()
    share, names = np.array([0.8, 0.1, 0.1]), ["train", "val", "test"]

    def cost(at):
        n, m = (np.bincount(at, c[x], 3) / len(out) for x in ("n", "m"))
        over, over_m = n - share, m - share * c["m"].sum() / len(out)
        return float((over**2 + 0.25 * (over_m**2 + (over - over_m) ** 2)).sum())

    got = cost(c["split"].map(names.index).to_numpy())
    starts = [rel.hashed_start(c["component"].to_numpy(object), share), rel.largest_first(c["n"].to_numpy(float), share * len(out))]
    assert got <= min(map(cost, starts)) and got < 1e-4
    assert max(abs((c["n"][c["split"] == x].sum()) / len(out) - p) for x, p in zip(names, share)) < 0.005


def test_large_components_are_annealed_with_their_labels(spark, data):
    """Half of the components have no summaries: largest first alone leaves their share in the splits to chance."""
    rng = random.Random(5)
    sizes = [rng.randrange(20, 60) for _ in range(60)]
    rows = [(i * 1000 + j, f"x{i}", "c", "s" if i % 2 else None, None, 1) for i, n in enumerate(sizes) for j in range(n)]
    out = rel.assign_splits(pairs_of(spark, rows), spark.read.parquet(f"{data}/channels.parquet")).collect()
    label = {r[0]: r[3] is not None for r in rows}
    for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        of = [label[r["pair_id"]] for r in out if r["split"] == name]
        assert abs(len(of) - share * len(rows)) <= 0.005 * len(rows)
        assert abs(sum(of) - share * sum(label.values())) <= 0.005 * len(rows)


def moments_of(spark, rows):
    return ("moment_data", spark.createDataFrame(rows, "moment_id long, messages array<string>, rep long"), "moment_id", "messages")


def test_hidden_duplicates(spark, rows):
    a = ["[00:00:01] ann: Hello, you", "[00:00:02] bob: second"]
    b = ['{"text":"hello YOU!","time":"00:00:01","user":"Ann"}', None, "", "user=bob | text=SECOND | time=00:00:02"]
    t = moments_of(spark, [(1, a, 0), (2, b, 0), (3, a[::-1], 0), (4, ["ann: Hello, you", "bob: second"], 0), (5, None, 0), (6, [], 0), (7, [" "], 0), (8, b, 0)])
    assert rows(dup.duplicate_pairs([t])) == [("moment_data", 1, 2), ("moment_data", 1, 8), ("moment_data", 2, 8)]
    assert {r["rec_id"]: r["copies"] for r in dup.collapse([t]).collect()} == {1: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert dup.duplicate_pairs([moments_of(spark, [])]).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(dup, "_prints", lambda key, messages: iter([(key, 1, 0, 0)]))
    t = moments_of(spark, [(1, ["a"], 0), (2, ["a"], 0), (3, ["b"], 0), (4, ["b"], 0), (5, ["c"], 0)])
    assert rows(dup.duplicate_pairs([t])) == [("moment_data", 1, 2), ("moment_data", 3, 4)]


def test_fingerprint_ignores_order():
    f = ["0|a|x", "1|b|y", "2|c|z"]
    assert dup.fingerprint(iter(f)) == dup.fingerprint(iter(f[::-1])) != dup.fingerprint(iter(f[:2]))


@pytest.mark.parametrize(
    "texts, want",
    [
        (["hello there everyone", "hello there everyone", "x"], [(0, 2)]),
        (["hello there everyone", "Hello  there, everyone!!", "helllllo there everyone"], [(0, 3)]),
        (["hello there everyone", "hello tehre everyone", "hello there everyone lol"], [(0, 3)]),
        (["hello tehre everyone", "hello there evreyone"], [(0, 2)]),
        (["hello there", "hello thre"], []),  # fewer than 14 letters
        (["lol", "LOL!", "loool"], [(0, 3)]),
        (["we need six more votes", "we need ten more votes"], []),
        (["subscribed at Tier 1 today", "subscribed at Tier 2 today"], []),
        (["🔥🔥🔥", "🔥🔥🔥", "😂"], [(0, 2)]),
        (["a", "b", "a"], []),
        (["same text right here"] * 2 + ["other text right there"] * 3, [(0, 2), (2, 5)]),
        (["do you ever cook on stream", "do you eer cook on stream"], [(0, 2)]),
        ([], []),
        (["one"], []),
    ],
)
def test_runs(texts, want):
    assert runs.spans(texts) == want


def test_collapsed_runs(spark, rows):
    t = moments_of(spark, [(1, ["[23:59:59] a: hello there everyone", "[00:00:09] b: hello there everyone", None, "[00:00:10] c: bye"], 0), (2, ["x"], 0), (3, None, 0)])
    assert rows(runs.repeated_runs([t])) == [("moment_data", 1, 1, 2)]
    assert rows(runs.collapse_runs([t])) == [("moment_data", 1, 1, "a", "hello there everyone", 2, 10), ("moment_data", 1, 3, "c", "bye", 1, 0), ("moment_data", 2, 1, None, "x", 1, None)]


def test_runs_of_very_long_records():
    assert runs.spans(["message number %d of many" % (i // 2) for i in range(4000)]) == [(i, i + 2) for i in range(0, 4000, 2)]


def overlap_brute(rows):
    from collections import Counter

    bags = {k: (s, Counter(over.words_of(c))) for k, _, c, _, s, _ in rows if c and over.words_of(c)}
    out = set()
    for (a, (sa, x)), (b, (sb, y)) in itertools.combinations(sorted(bags.items()), 2):
        if (sa == "train") != (sb == "train") and {sa, sb} <= {"train", "val", "test"} and sum((x & y).values()) >= 0.8 * max(x.total(), y.total()):
            out.add((a, b))
    return out


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(40)]
    rows = []
    for k in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(999)}"
        chat = "\n".join(f"u{k}: " + " ".join(words[i : i + 10]).capitalize() for i in range(0, 60, 10))
        rows.append((k, None, chat, "s", rng.choice(["train", "train", "val", "test", None]), 1))
    rows += [(900, None, None, "s", "train", 1), (901, None, " ", "s", "val", 1), (902, None, "u: GG", "s", "train", 1), (903, None, "[00:00:01] v: gg!", "s", "test", 1), (904, None, "🔥", "s", "val", 1)]
    got = {tuple(r) for r in over.overlap_pairs(pairs_of(spark, rows)).collect()}
    assert got == overlap_brute(rows) and (902, 903) in got and len(got) > 50
    report = over.overlap_report(pairs_of(spark, rows)).collect()
    assert sum(r["pairs"] for r in report) == len(got)
    assert over.overlap_pairs(pairs_of(spark, [])).count() == 0


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95, 0.983])
def test_overlap_at_each_similarity(spark, share):
    """Copies of 60-word chats with just that share of words left, words and lines in another order."""
    rng = random.Random(int(share * 1000))
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        copy = list(words)
        for i in rng.sample(range(60), 60 - -(-int(share * 600) // 10)):
            copy[i] = f"z{rng.randrange(10**6)}"
        rng.shuffle(copy)
        for j, (w, split) in enumerate(((words, "train"), (copy, "val"))):
            rows.append((2 * k + j, None, "\n".join(f"u: {' '.join(w[i : i + 10])}" for i in range(0, 60, 10)), "s", split, 1))
    got = {tuple(r) for r in over.overlap_pairs(pairs_of(spark, rows)).collect()}
    assert got == overlap_brute(rows) and {(2 * k, 2 * k + 1) for k in range(60)} <= got


def test_overlap_is_exact_under_scattered_edits(spark):
    """Edits over every line, moved lines and chats of a few words: few or no 5-grams are left in common."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (4, 5, 5, 6, 9, 10, 25, 60, 60, 110) for _ in range(3)]
    rows = []
    for k in range(400):
        words = list(rng.choice(base))
        for i in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.1, 0.15, 0.2, 0.21, 0.25]))):
            words[i] = f"z{rng.randrange(99)}"
        words = words[: len(words) - rng.randrange(2)] if k % 3 == 0 else words
        lines = [words[i : i + 4] for i in range(0, len(words), 4)]
        rng.shuffle(lines)
        rows.append((k, None, "\n".join(f"u{k}: " + " ".join(x) for x in lines), "s", rng.choice(["train", "train", "val", "test"]), 1))
    rows += [(900, None, "u: we all saw the owl", "s", "train", 1), (901, None, "u: we all met the owl", "s", "val", 1), (902, None, "u: we all the owl", "s", "test", 1)]
    got = [tuple(r) for r in over.overlap_pairs(pairs_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == overlap_brute(rows) and {(900, 901), (900, 902)} <= set(got)


def test_a_third_of_all_rows_in_one_group(spark):
    hot = "a: " + " ".join(f"k{i}" for i in range(30))
    rows = [(i, None, hot if i % 3 == 0 else f"b: other {i} " + " ".join(f"q{i}_{j}" for j in range(20)), "s", "train" if i % 2 else "val", 1) for i in range(600)]
    df = pairs_of(spark, rows)
    assert over.overlap_pairs(df).count() == 100 * 100
    assert dup.collapse([("summary_pairs", df, "pair_id", "chat")]).where("copies = 200").count() == 1


def test_nulls_and_clashing_columns(spark, data):
    """Null keys and fields, repeated rows and extra columns with the names that operators use inside."""
    schema = PAIRS + ", component string, source_key string, rep long, bag string, copies long, look string, n long, tbl string, rec_id long"
    extra = ("c", "k", 1, "b", 2, "l", 3, "t", 4)
    chat = "u: one and the same chat of some words\nv: and a line of it"
    rows = [(None, None, None, None, None, None), (None, "a_s00000001_1", chat, "s", "train", 1), (1, None, chat, None, "val", 1), (2, "A_S00000001_2", chat, "s", "train", 1), (2, "A_S00000001_2", chat, "s", "train", 1), (3, None, None, " ", "test", 1)]
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    channels = spark.createDataFrame([(1, "a", None, "x", "c"), (None, "b", "o", "x", "c"), (2, None, None, "x", "c")], CHANNELS + ", component string")
    assert rel.tied_channels(df, channels).count() == 0
    assert rel.assign_splits(df, channels).count() == len(rows)
    assert {tuple(r) for r in over.overlap_pairs(df).collect()} == {(1, 2)}
    t = [("summary_pairs", df, "pair_id", "chat")]
    assert {r["rec_id"] for r in dup.collapse(t).collect()} >= {1, 3}
    assert dup.duplicate_pairs(t).where("key_a IS NULL OR key_b IS NULL").count() == 0
    assert runs.repeated_runs(t).count() == 0 and runs.collapse_runs(t).count() > 0


def test_hot_keys_take_the_other_way_to_the_same_result(spark, data, rows, monkeypatch):
    """With every key of more than a few rows taken as hot, results are those of the shuffle joins."""
    from chatloom import session
    from chatloom.llm import broken_pairs, lookalike
    from chatloom.llm.lines import chat_tables

    def results():
        pairs, channels, docs = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("summary_pairs", "channels", "documents"))
        many = pairs.selectExpr("*", "explode(sequence(0, 5)) AS again").selectExpr("pair_id * 10 + again AS pair_id", "chat", "split")
        return [rows(x) for x in (dup.duplicate_pairs(chat_tables(spark, data)), over.overlap_pairs(many), lookalike.lookalike_pairs(docs), broken_pairs.broken(pairs), rel.tied_channels(pairs, channels))]

    want = results()
    monkeypatch.setattr(session, "HOT", 2)
    monkeypatch.setattr(dup, "HOT", 2)
    monkeypatch.setattr(over, "HOT", 3)
    assert results() == want and all(want[:4])
