import itertools
import random

import pytest

from chatloom.llm import abuse, broken_pairs, encoding, lookalike, mixing, personal_info

PAIRS = "pair_id long, id string, chat string, summary string, closed int"
MOMENTS = "moment_id long, file_name string, messages array<string>, n long"


def moments_of(spark, rows):
    return ("moment_data", spark.createDataFrame(rows, MOMENTS), "moment_id", "messages")


# personal information


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("write me at a.b+c@sub.mail.example please", {"email"}),
        ("write me at ab (at) mail.example", {"email"}),
        ("mine is ab[at]mail[dot]example", {"email"}),
        ("mine is ab at mail dot example", {"email"}),
        ("follow @the_quill and say hi at the gym", set()),
        ("call +44 7700 900123 now", {"phone"}),
        ("(412) 555-0194 ring twice", {"phone"}),
        ("01 99 00 61 29 ok", {"phone"}),
        ("0049-30-23125788 ok", {"phone"}),
        ("his high score is 8812345678 points", set()),
        ("the world seed is 4412-889-2210 if you want", set()),
        ("coordinates are 1204 88 -310, near the bakery", set()),
        ("new personal best is 01:22:33.456", set()),
        ("build 10.4.2201 fixed it", set()),
        ("use code MOSS-4471-KITE now", set()),
        ("ssn 914-38-1802 lol", {"id_number"}),
        ("it is QQ 22 94 42 C", {"id_number"}),
        ("card 4111 1111 1111 1111", {"id_number"}),
        ("card 4111 1111 1111 1112", set()),
        ("I live at 12 Kettle Road, Harwick", {"address"}),
        ("po box 12 it is", {"address"}),
        ("meet at Picklestrasse 89 tonight", {"address"}),
        ("we are on level 12, take the left street after the bakery", set()),
        ("my real name is Hestia A. Vossmere", {"name"}),
        ("signed, ms silverdell", {"name"}),
        ("Rudgewell, Petra from my school said hi", {"name"}),
        ("no way Captain Gristle drops that", set()),
        ("how did you miss the velvet shield", set()),
        ("he read out Ms Dunholt then 815-555-0108", {"name", "phone"}),
        ("", set()),
    ],
)
def test_personal_info(text, kinds):
    assert {personal_info.KINDS[k] for _, _, k in personal_info.found(text)} == kinds
    assert {i: {personal_info.KINDS[k] for _, _, k in cases} for i, cases in personal_info.found_in(["nothing here", text, ""])} == ({1: kinds} if kinds else {})


def test_redaction(spark, rows):
    assert personal_info.redact("[00:00:01] ann: call me on 07700 900123, thanks") == "[00:00:01] ann: call me on <PHONE>, thanks"
    assert personal_info.redact('{"text": "I \\u00e9 live at 12 Kettle Road", "user": "x"}').count("<ADDRESS>") == 1
    t = moments_of(spark, [(1, "a", ["u: mail me at x@y.example", None, "u: hi"], 0), (2, "a", None, 0), (3, "a", [], 0)])
    assert rows(personal_info.personal_info([t])) == [("moment_data", 1, 1, "email")]
    assert [r["messages"] for r in personal_info.redacted([t]).collect()] == [["u: mail me at <EMAIL>", "u: hi"]]
    long = "x " * 200_000 + "a@b.example"
    assert [k for _, _, k in personal_info.found(long)] == [personal_info.EMAIL]
    for text in ("a" * 200_000 + " @ b", "a." * 100_000 + "@", "a1 " * 60_000 + "street", "ab" * 100_000 + " and x from my school", "1" * 200_000, "1 " * 100_000, "a b " * 50_000):
        personal_info.found(text)


ADDRESS_FORMS = [
    *(f"12 Oak {w.title()}" for w in "street st road rd avenue ave drive lane ln boulevard blvd court ct terrace close crescent square way".split()),
    *(f"3 {w} des Lilas" for w in "rue avenue boulevard place chemin impasse allée".split()),
    *(f"Linden{w} 9" for w in "strasse straße gasse allee platz".split()),
    *(f"{w} Roma 7" for w in "calle avenida plaza paseo rua via".split()),
    "po box 5", "P O Box 5", "PO. Box 5", "P.O. Box  5",
]


def test_every_address_form_has_an_anchor():
    """At a message's end, before marks and alone, and in both queries."""
    for text in ADDRESS_FORMS:
        for end in ("", "!", "?", ".", ", ok"):
            got = [k for _, _, k in personal_info._found(1, ["u: hi", f"u: {text}{end}", "u: bye"])]
            assert got == ["address"], (text, end)
            assert "<ADDRESS>" in next(personal_info._redacted(1, ["u: hi", f"u: {text}{end}"]))[1][1], (text, end)


# tokens


def test_encoding_pieces_equal_whole():
    enc, rng = encoding.encoding(), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "1", "23", "'s", "é", "🔥", "—", "\t", "don't", "x" * 9, "."]) for _ in range(rng.randrange(120)))
        assert encoding.encode_text(text, enc, 7) == enc.encode_ordinary(text)
        assert enc.decode_bytes(encoding.encode_text(text, enc)).decode() == text
    assert "".join(encoding.pieces("x" * 100, 10)) == "x" * 100


def test_encoding_of_very_long_runs():
    enc = encoding.encoding()
    for text in (" " * 2500, "a" + " " * 3000 + "b", "a." + "\n" * 2048 + " b", " " * 2100 + "\n" + "c" + " " * 2100, "x" * 3000 + "\t" * 2200 + "9", "é" + "\u3000" * 2300 + "é"):
        assert encoding.encode_text(text, enc) == enc.encode_ordinary(text)
    for sign in (" ", "\n", "a", "1", "!", "é", "\u00a0", "🔥"):
        text = sign * 1_000_000 + "z"
        assert enc.decode(encoding.encode_text(text, enc)) == text


def test_encoding_defined_cases(spark):
    df = spark.createDataFrame([(1, "hi <|endoftext|>", 5), (2, "", 5), (3, None, 5)], "doc_id long, text string, ids int")
    out = {r["doc_id"]: r["ids"] for r in encoding.encoded(df).collect()}
    assert out[2] == [] and out[3] == [] and 50256 not in out[1]
    assert {r["doc_id"]: r["text"] for r in encoding.decoded(encoding.encoded(df)).collect()} == {1: "hi <|endoftext|>", 2: "", 3: ""}
    assert {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(df).collect()} == {1: len(out[1]), 2: 0, 3: 0}


# look-alikes


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Chat", "Ｃｈａｔ", True),
        ("Chat", "С​hаt", True),
        ("café", "café", True),
        ("a b", "a b", True),
        ("a\tb", "a b", True),
        ("a\r\nb", "a\nb", True),
        ("fin", "ﬁn", True),
        ("a-b", "a‑b", True),
        ("a­b", "ab", True),
        ("cafe", "café", False),
        ("Chat", "chat", False),
        ("x2", "x²", False),
        ("a", "ä", False),
        ("1", "①", False),
        ("a b", "ab", False),
    ],
)
def test_lookalike_forms(a, b, same):
    assert (lookalike.form(a) == lookalike.form(b)) is same
    assert lookalike.form(lookalike.form(a)) == lookalike.form(a)


def test_lookalike_pairs(spark, rows):
    df = spark.createDataFrame([(1, "Chat", 0), (2, "Ｃhat", 0), (3, "Chat", 0), (4, "chat", 0), (5, None, 0), (6, " ", 0), (7, " ", 0), (8, "", 0), (9, "Сhat", 0)], "doc_id long, text string, raw int")
    assert rows(lookalike.lookalike_pairs(df)) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert lookalike.consistent(df).count() == 9 and lookalike.form("ÀB", True) == "àb"
    assert sorted((r["doc_id"], r["copies"], r["texts"]) for r in lookalike.look_classes(df).collect()) == [(1, 4, 3), (2, 4, 3), (3, 4, 3), (4, 1, 1), (9, 4, 3)]
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id = 7, 'ｘ', 'x') AS text")
    assert lookalike.lookalike_pairs(hot).count() == 2999


# mixing


def test_flow_and_largest_total():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 10)]
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    total = mixing.largest_total(patterns, shares, repeats)
    done, flow = mixing.route(patterns, shares, repeats, total)
    assert done == round(total * 0.5) * 2 and 318 <= total <= 320  # a: 100 + 60, b: 20 + 140
    assert flow[1, "b"] >= 138  # the shared pattern goes where it is needed
    done, flow = mixing.route([(("a",), 100), (("b",), 100)], shares, {"a": 3, "b": 3}, 200)
    assert flow == {(0, "a"): 100, (1, "b"): 100}


def test_flow_is_cheapest():
    """Against all integer flows of small instances: most tokens first, then least cost."""

    def cost_of(used, patterns):
        return sum(k for p, x in used.items() for k in (i // patterns[p][1] for i in range(x)))

    rng = random.Random(3)
    for _ in range(30):
        patterns = [(("a",), rng.randrange(1, 3)), (("a", "b"), rng.randrange(1, 3)), (("b",), rng.randrange(1, 3))]
        repeats, total = {"a": rng.randrange(1, 3), "b": rng.randrange(1, 3)}, rng.randrange(2, 9)
        arcs = [(p, s) for p, (m, _) in enumerate(patterns) for s in m]
        best = None
        for flow in itertools.product(*(range(patterns[p][1] * repeats[s] + 1) for p, s in arcs)):
            quota, used = {}, {}
            for (p, s), x in zip(arcs, flow):
                quota[s], used[p] = quota.get(s, 0) + x, used.get(p, 0) + x
            if all(x <= round(0.5 * total) for x in quota.values()) and all(x <= patterns[p][1] * max(repeats[s] for s in patterns[p][0]) for p, x in used.items()):
                key = (-sum(quota.values()), cost_of(used, patterns))
                best = key if best is None else min(best, key)
        done, got = mixing.route(patterns, {"a": 0.5, "b": 0.5}, repeats, total)
        used = {}
        for (p, _), x in got.items():
            used[p] = used.get(p, 0) + x
        assert (-done, cost_of(used, patterns)) == best


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))), rng.choice(["big"] * 6 + ["small", "other"]), 0) for i in range(3000)]
    rows += [(5000, None, "big", 0), (5001, "", "big", 0), (5002, "x y z", None, 0), (5003, rows[0][1], rows[0][2], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(df, targets).collect()
    assert {r["source"] for r in m} == {"big", "small"} and 5003 not in {r["doc_id"] for r in m}
    assert max(r["copies"] for r in m if r["source"] == "small") <= 3 and max(r["copies"] for r in m if r["source"] == "big") == 1
    s = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert abs(s["small"]["actual_share"] - 0.6) < 0.005 and abs(s["big"]["actual_share"] - 0.4) < 0.005 and s["absent"]["documents"] == 0
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixing.mixed(df.repartition(7), targets).collect()))
    assert mixing.mixed(df.limit(0), targets).count() == 0
    fixed = mixing.mixed(df, targets, total=1000).selectExpr("sum(n_tokens * copies)").first()[0]
    assert 900 <= fixed <= 1100


def test_registered_mix_follows_the_corpus(spark, tmp_path):
    """A source of one short text falls short; it doesn't shrink the mix to a few documents."""
    from chatloom.llm.queries import QUERIES

    docs = [(i, f"text number {i} of a long list of texts", "big" if i % 2 else "other") for i in range(400)] + [(900, "one", "scarce")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.5, 2), ("other", 0.4, 2), ("scarce", 0.1, 3)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    s = {r["source"]: r for r in QUERIES["p9_shares"](spark, str(tmp_path)).collect()}
    assert s["scarce"]["most_copies"] == 3 and s["scarce"]["actual_share"] < 0.01
    assert s["big"]["documents"] == 200 and s["other"]["documents"] >= 150 and abs(s["big"]["actual_share"] / s["other"]["actual_share"] - 1.25) < 0.02
    assert {r["source"] for r in QUERIES["p9_mix"](spark, str(tmp_path)).collect()} == set(s)


def test_more_patterns_than_any_cap(spark):
    """Thousands of membership patterns: a source that only has shared texts still gets its share."""
    rng = random.Random(8)
    names = [f"s{i:02d}" for i in range(14)]
    sets = {tuple(sorted(rng.sample(names, rng.randrange(2, 9)))) for _ in range(7000)}
    patterns = [(m, rng.randrange(1, 50)) for m in sorted(sets)]
    shares = {s: 0.05 for s in names} | {"s13": 0.35}
    total = sum(t for _, t in patterns)
    done, flow = mixing.route(patterns, shares, dict.fromkeys(names, 1), total)
    assert len(patterns) > 4096 and done == min(total, sum(round(x * total) for x in shares.values())) == sum(flow.values())
    assert all(s in patterns[p][0] for p, s in flow)
    used = {}
    for (p, _), x in flow.items():
        used[p] = used.get(p, 0) + x
    assert all(x <= patterns[p][1] for p, x in used.items())


# abuse


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        got = abuse.segments(s)
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        assert max((x for _, _, x in got), default=0.0) == pytest.approx(max(best, 0))
        assert all(x == pytest.approx(sum(s[a:b])) and x > 0 for a, b, x in got)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/abuse_labels.parquet")


def test_abuse_held_out(spark, labels):
    """Trained on two thirds of the sample, the rest is told apart."""
    rows = [r for r in labels.where("label IS NOT NULL").orderBy("label_id").collect()]
    train, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    bg = moments_of(spark, [(i, "a", [f"u: {r['message']}" for r in rows if r["label"] == "none"], 0) for i in range(3)])
    model, spelling = abuse.trained([bg], spark.createDataFrame([(r["label_id"], r["message"], r["label"]) for r in train], "label_id long, message string, label string"))
    flag = [(abuse.message_strength(r["message"], model, spelling) >= 4, r["label"] != "none") for r in held]
    hit, false, miss = (sum(f and y for f, y in flag), sum(f and not y for f, y in flag), sum(y and not f for f, y in flag))
    assert hit / (hit + miss) >= 0.95 and hit / (hit + false) >= 0.97


@pytest.mark.parametrize("text", ["go k.y.s already", "you are such an 1d10t", "what a b*tch", "you pathetic l o s e r nobody asked", "hijo de puta", "halt die Fresse", "send nudes pls"])
def test_abuse_spellings(spark, labels, text):
    bg = moments_of(spark, [(1, "a", ["u: please do not sell the rake"], 0)])
    model, spelling = abuse.trained([bg], labels)
    assert abuse.message_strength(text, model, spelling) > 1


@pytest.mark.parametrize(
    "text, toxic",
    [
        ("the boss will kill you in two hits", False), ("I will kill you and your family", True), ("that boss is a bastard", False), ("marmot is a bastard", True), ("you absolute bastard", True),
        ("this controller is a piece of shit", False), ("I am such an idiot, forgot the key again", False), ("what an idiot you are", True), ("saying kys gets you banned here", False), ("kys", True),
        ("the rats in the sewer carry diseases", False), ("those immigrants carry diseases", True), ("my whole party is going to be wiped out", False), ("he kicked her ass in the final round", False),
        ("loser of the bet buys pizza", False), ("my save file disappeared forever", False), ("nobody would miss you", True), ("you are such a good healer, never stop", False), ("imagine being this good at jumping", False),
        ("if you fall there the lava will kill you, I swear", False), ("feed the pig before you go in", False), ("you filthy pig", True), ("the king's men carry diseases", False), ("we are so bad at this, useless team today", False), ("your whole family is worthless", True),
        ("Ich bring dich um", True), ("i hope he gets cancer", True), ("tu es une merde", True),
    ],
)
def test_abuse_needs_somebody_it_is_aimed_at(spark, labels, text, toxic):
    """Wordings of neither the sample nor the tables: harmless senses, things, oneself and moderation are no cases."""
    key = "model"
    if key not in _trained:
        bg = moments_of(spark, [(1, "a", [f"u: {r['message']}" for r in labels.where("label = 'none'").collect()], 0)])
        _trained[key] = abuse.trained([bg], labels)
    assert (abuse.message_strength(text, *_trained[key]) >= 4) is toxic


_trained = {}


def test_abuse_records_and_rates(spark, labels, rows):
    t = moments_of(spark, [(1, "Chan_A.json", ["u: you are such a moron, uninstall and never come back", "u: hi"], 0), (2, "chan-a.JSON ", ["u: kill the boss already, shoot him in the head", "u: the vermin quest in the bakery is so annoying"], 0), (3, None, None, 0)])
    assert rows(abuse.flagged([t], labels)) == [("moment_data", 1)]
    got = {r["channel"]: (r["records"], r["flagged"]) for r in abuse.rates([t], labels, {"moment_data": "file_name"}).collect()}
    assert got["chana"] == (2, 1)
    assert abuse.scored([moments_of(spark, [])], labels.limit(0)).count() == 0


# broken pairs

CLEAN = ["Chat laughs at the {} mishap while the streamer wanders on.", "Viewers greet newcomers and plan a marathon of {} for the next month.", "The streamer refuses to sell the {} and says he can't help with the quest."]


@pytest.fixture(scope="module")
def injected(spark):
    """Clean pairs, a fifth of them corrupted: (pairs, defect by pair_id)."""
    rng = random.Random(4)
    names = ["rake", "kazoo", "ladle", "spoon", "acorn"]
    rows, want = [], {}
    for i in range(900):
        chat = "\n".join(f"u{rng.randrange(9)}: we are at the {rng.choice(names)} and it is {rng.choice(['good', 'bad', 'fun'])} for all of you" for _ in range(6))
        s = rng.choice(CLEAN).format(rng.choice(names))
        if i % 30 == 0:
            s, want[i] = rng.choice([None, " ", "N/A", "Summary:", "(empty)", "..."]), "empty"
        elif i % 30 == 1:
            s, want[i] = rng.choice(["I'm sorry, but I cannot provide a summary of this content.", "Unfortunately I have to decline this request.", "My policy does not let me discuss this chat."]), "refusal"
        elif i % 30 == 2:
            s, want[i] = ". ".join(x.split(": ")[1].upper() for x in chat.split("\n")[1:4]), "copy"
        elif i % 30 == 3:
            s, want[i] = rng.choice(["Los espectadores se ríen de la caída y piden que repita la canción.", "Зрители смеются над падением и просят ещё раз включить песню.", "視聴者はボス戦の勝利を喜び、冗談を言っている。"]), "language"
        elif i % 30 == 4:
            s, want[i] = CLEAN[i % 2].format("rake")[: rng.choice([14, 20, 30])], "truncated"
        elif i % 30 == 5:
            s = s.rstrip(".")
        rows.append((i, "x", chat if i != 7 else None, s, 1))
    return spark.createDataFrame(rows, PAIRS), want


def test_broken_pairs_injected(injected):
    df, want = injected
    got = {r["pair_id"]: r["defect"] for r in broken_pairs.broken(df).collect()}
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.95 * len(want) and len(got.keys() - want.keys()) <= 0.03 * len(want)
    assert broken_pairs.labelled(df).count() == df.count()
    assert broken_pairs.broken(df.limit(0)).count() == 0


def test_cutoffs_are_validated(injected):
    """On corrupted pairs, no other cutoff tells a defect apart better than the one in use by more than a hundredth of F1."""
    df, want = injected
    scores = {r["pair_id"]: r["posteriors"] for r in broken_pairs.labelled(df).collect()}
    for d, cut in broken_pairs.CUTOFFS.items():
        true = {k for k, v in want.items() if v == d}

        def f1(c, d=d, true=true):
            got = {k for k, p in scores.items() if p[d] > c}
            return 2 * len(got & true) / max(1, len(got) + len(true))

        assert f1(cut) >= max(f1(c / 20) for c in range(1, 20)) - 0.01 and f1(cut) > 0.9, d


def test_label_model_recovers_accuracies():
    rng = random.Random(9)
    from collections import Counter

    patterns, truth = Counter(), {}
    for _ in range(20000):
        y = rng.random() < 0.05
        p = tuple(int(rng.random() < (0.9 if y else 0.01)) if rng.random() < 0.8 else -1 for _ in range(4))
        patterns[p] += 1
        truth.setdefault(p, []).append(y)
    post = broken_pairs.fit(dict(patterns))
    assert sum(abs(post[p] - sum(t) / len(t)) * len(t) for p, t in truth.items()) / 20000 < 0.02
    assert broken_pairs.fit({}) == {}


def test_very_long_texts_are_read_whole():
    assert broken_pairs.votes("a" * 300_000, "I can " * 50_000)
    many = "\n".join(f"u: message number {i} of a long chat" for i in range(5000))
    assert broken_pairs.votes(many, ". ".join(f"Message number {i} of a long chat" for i in range(2000)))["copy"][0] == 1
    assert broken_pairs.ending("word " * 50_000 + "the")[1][-1] == "the"


def test_nulls_and_clashing_columns_of_texts(spark, labels):
    """Null keys and fields and extra columns with the names that operators use inside."""
    docs = spark.createDataFrame([(None, "Chat", "a"), (1, "Ｃhat", "a"), (2, "Chat", None), (2, "Chat", None), (3, None, "a")], "doc_id long, text string, source string").selectExpr("*", "1 AS form", "2 AS look", "3 AS n_tokens", "4 AS copies", "5 AS hash", "6 AS pattern", "7 AS ids")
    targets = spark.createDataFrame([("a", 1.0, 2, 5, 6), (None, 0.5, 1, 5, 6), ("z", None, None, 5, 6)], "source string, target_share double, max_repeats int, tokens int, documents int")
    assert {tuple(r) for r in lookalike.lookalike_pairs(docs).collect()} == {(1, 2)} and lookalike.consistent(docs).count() == 5
    assert encoding.encoded(docs).count() == 5 and mixing.mixed(docs, targets, mixing.CORPUS).count() >= 1 and mixing.shares(docs, targets).count() == 3
    pairs = spark.createDataFrame([(None, None, None, None, 1), (1, None, "u: hi all", "Viewers greet each other.", 1)], PAIRS).selectExpr("*", "1 AS grams", "2 AS known", "3 AS word", "4 AS defects")
    assert broken_pairs.labelled(pairs).count() == 2
    t = ("moment_data", spark.createDataFrame([(None, None, ["u: you absolute bastard, mail me at a@b.example"], None), (1, None, [None, ""], 1)], MOMENTS).selectExpr("*", "1 AS rec_id", "2 AS body", "3 AS tbl"), "moment_id", "messages")
    assert personal_info.personal_info([t]).count() == 1 and personal_info.redacted([t]).count() == 1 and abuse.scored([t], labels).count() == 1


@pytest.mark.parametrize("unit", [" ", "a ", "1", " | ", "\t", "[", "@", "a.", "*", "é", "$1", "mr ", "and x ", "12 a ", "！"])
def test_very_long_runs_take_no_long_time(unit):
    """Time grows in proportion to the text, whatever repeats in it."""
    import time

    from chatloom.llm import hidden_duplicates, repeated_runs, split_overlap

    spelling = abuse.Spelling(["idiot"])
    model = abuse.Model([("you idiot", "abusive"), ("hello there", "none")], {"": 100}, spelling)
    text = "u: a" + unit * (60_000 // len(unit)) + "b."
    for f in (lookalike.form, personal_info.redact, lambda s: abuse.message_strength(s, model, spelling), lambda s: broken_pairs.votes(s, s), broken_pairs.ending, lambda s: repeated_runs.spans([s, s + "x"]), lambda s: list(hidden_duplicates.fields_of([s])), split_overlap.words_of):
        start = time.perf_counter()
        f(text)
        assert time.perf_counter() - start < 3
