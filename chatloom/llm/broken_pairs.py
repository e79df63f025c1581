"""Defective pairs of chat and summary, by labelling functions and an expectation-maximization label model.

Several noisy labelling functions vote for or against each defect (1, 0, or -1 for
abstaining). Vote patterns are counted over all pairs (at most 3^k of them reach the
driver, k functions a defect), a two-class label model is fitted to the counts by
expectation-maximization with priors on the functions' accuracies, and every pair
keeps all defects whose posterior exceeds that defect's cutoff. Where one defect is
asked for, the first of the order in DEFECTS is taken: an empty or refusing summary
is nothing else, a copy is not also judged by its language or ending.

Whether a summary breaks off is learnt from all summaries: the longest word n-gram
at its end that the corpus knows either closes sentences elsewhere or never does.

Defined cases: a null or blank chat alone is no defect (its language and copies
can't be judged); null and blank summaries are empty; languages that neither words
nor script tell are not judged; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.lines import alnum_key, lines_of, parse_line
from chatloom.session import hot_joined, stored

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
#: Posterior beyond which a pair keeps a defect; validated on corrupted clean pairs in tests/llm.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "language": 0.5, "truncated": 0.5}
#: Longest word n-gram looked at for endings, and how often it must occur to count.
GRAM, KNOWN = 5, 3

# Placeholders, labels, refusal wording and function words of languages.
PLACEHOLDERS = frozenset("na none null nil tbd todo empty blank missing undefined nosummary nosummaryavailable notavailable notapplicable summaryunavailable nosummaryyet pending placeholder nan".split())
LABEL = re.compile(r"^\s*(?:\**(?:summary|chat|chat summary|answer|response|output|tl;?dr|resumen|résumé|zusammenfassung|resumo|итог)\**\s*[:：-]\s*)+", re.I)
FIRST_PERSON = re.compile(
    r"\b(?:i|we)(?:'m|’m| am| are)? (?:really )?(?:can ?not|can['’]t|could not|won['’]t|will not|wouldn['’]t|would not|am unable|unable|not able|don['’]t feel|do not feel|must|have to|do not have|don['’]t have|['’]?d rather not|would rather not|refuse|decline|cannot|prefer not)"
    r"|\bi(?:['’]m| am) not (?:comfortable|going|allowed|permitted|willing|in a position)|\bi should(?:n['’]t| not)\b|\bi['’](?:d rather not|m (?:unable|not able|afraid|sorry)|ll have to)|\bmy (?:policy|guidelines|apologies|instructions|programming)\b|\bappropriate for me\b|\bfor me to\b|\bno summary can be\b|\b(?:let|allow|permit)s? me\b"
    r"|\bno puedo\b|\blo siento\b|\bje ne (?:peux|suis)\b|\bje suis désolé|\bich kann (?:das |dies |diese[nrs]? |leider )?.{0,40}nicht\b|\bes tut mir leid\b|\bnão posso\b|\bdesculpe\b|не могу|извините|\bprzepraszam\b|\bnie mogę\b|申し訳|できません",
    re.I,
)
OWN = re.compile(r"\b(?:i|me|my|we|our)\b|['’]m\b|\b(?:yo|je|ich|eu|mi|mich)\b|\bя\b", re.I)
OPENING = re.compile(r"^\W*(?:(?:hello|hi|hey|thanks for sharing|thank you)\b[^.]{0,20}[,!.]?\s*(?:however|but)?\s*)?(?:i['’]?m (?:really )?sorry|sorry|my apologies|apologies|unfortunately|as an? (?:\w+ )?(?:assistant|language model|ai)\b|regrettably|lo siento|désolé|es tut mir leid|leider|desculpe|infelizmente|к сожалению)", re.I)
POLICY = re.compile(r"\b(?:guidelines?|polic(?:y|ies)|safety reasons|sensitive material|against my|not something (?:i|that)|something (?:that )?i (?:can|am|do|will)|blocked|not (?:be )?appropriate|inappropriate|assistant|language model|decline|let me discuss|content rules)\b", re.I)
# Every match of the patterns above has one of these words; only texts with one are searched.
SPEAKERS = frozenset("i we my me summary puedo siento je ich mir posso desculpe могу извините przepraszam mogę".split())
OWN_WORDS = frozenset("i me my we our m yo je ich eu mi mich я".split())
POLICY_WORDS = frozenset("guideline guidelines policy policies safety sensitive against something blocked appropriate inappropriate assistant language decline discuss rules".split())
TASK = re.compile(r"\b(?:summari[sz]\w*|condens\w*|this (?:chat|conversation|request|content|text|transcript)|these messages|that request|comment on|help with|provide|assist|anything else)\b", re.I)
WORDS = {
    "en": "the and is to of in that for with on at his he they it was are this you a an by from about their after while because who all before if not my so",
    "es": "el la los las de que y en un una por con para del se su al lo no más pero como está muy hay ya sin cuando entre esta este",
    "fr": "le la les des et un une du dans pour que qui sur avec est au pas en se ce il on ne plus après aux sa son mais cette jamais",
    "de": "der die das und ist nicht ein eine zu den dem mit auf für von sich im es auch wird nach über sie ich er noch als wie vor beim aus einen gehen",
    "pt": "o a os as de que e em um uma do da no na por com para se não mais ao dos das seu sua está muito foi quando pelo depois até já",
    "it": "il lo la gli le di che e un una per con del della si non più nel alla sono come dopo dei anche",
    "pl": "i w na z się nie do że jest to o po za od jak przez dla przed ale tym jego przy gdy oraz który wielu",
    "nl": "de het een en van in is op te dat met voor niet zijn aan er ook naar om bij",
    "ru": "и в на с не что по за как это он из к но у от для снова уже его так все после перед над",
    "uk": "і в на з не що за як це він до але від для та його після перед над є",
    "sv": "och det att en som på är av för med den till inte om ett men efter",
    "tr": "ve bir bu için ile çok da de ne gibi daha sonra ama kadar olarak",
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _ws in WORDS.items():
    for _w in _ws.split():
        _BY_WORD.setdefault(_w, []).append(_lang)
SIGNS = {"es": "ñ¿¡", "de": "ßäöü", "fr": "œèêçùû", "pt": "ãõ", "pl": "łżźśćąęń", "ru": "ыэъё", "uk": "іїєґ", "tr": "ğış", "sv": "å"}
_BY_SIGN = {c: k for k, v in SIGNS.items() for c in v}
DANGLING = frozenset("the a an and or of to in on at for with by from about their his her its that which because while but so el la los las de del y en un una por con para que le les des du et dans der die das und mit auf für von zu den dem o os as da do em um uma и в на с i w na z się".split())
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"'”’»)\]]*\s+|\n+")
CLOSED = re.compile(r"[.!?。！？…][\"'”’»)\]*]*$")
SCRIPTS = (("kana", "぀", "ヿ"), ("han", "一", "鿿"), ("hangul", "가", "힯"), ("cyrillic", "Ѐ", "ӿ"), ("arabic", "؀", "ۿ"), ("greek", "Ͱ", "Ͽ"), ("hebrew", "֐", "׿"), ("thai", "฀", "๿"), ("devanagari", "ऀ", "ॿ"))


FOREIGN = re.compile("[" + "".join(f"{a}-{b}" for _, a, b in SCRIPTS) + "]")
NOT_KEY = re.compile(r"[^\w\n]|_")
LETTER, LETTERS = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")


def script(text: str) -> str | None:
    """The script of most letters; None without letters."""
    foreign = [] if text.isascii() else FOREIGN.findall(text)
    if not foreign:
        return "latin" if LETTER.search(text) else None
    n: Counter[str] = Counter()
    for c, k in Counter(foreign).items():
        n[next(name for name, a, b in SCRIPTS if a <= c <= b)] += k
    if n["kana"]:
        n["kana"] += n.pop("han", 0)
    n["latin"] = len(LETTER.findall(text)) - len(foreign)
    return n.most_common(1)[0][0]


def by_words(text: str) -> str | None:
    """The language whose function words are most frequent, if that is clear; scripts of one language tell it by themselves."""
    own = {"kana": "ja", "han": "zh", "hangul": "ko"}.get(script(text) or "")
    if own:
        return own
    n: Counter[str] = Counter()
    for w, k in Counter(LETTERS.findall(text.lower())).items():
        for lang in _BY_WORD.get(w, ()):
            n[lang] += k
    top = n.most_common(2)
    if not top or top[0][1] < 2 or (len(top) > 1 and top[0][1] < 1.25 * top[1][1]):
        return None
    return top[0][0]


def by_signs(text: str) -> str | None:
    """The language of the telling letters."""
    if text.isascii():
        return None
    n = Counter(_BY_SIGN[c] for c in text.lower() if c in _BY_SIGN)
    top = n.most_common(2)
    return top[0][0] if top and (len(top) == 1 or top[0][1] >= 2 * top[1][1]) else None


def alnum_keys(joined: str) -> list[str]:
    """``alnum_key`` of every line of a text at once."""
    if not joined.isascii():
        joined = unicodedata.normalize("NFKC", joined)
    return NOT_KEY.sub("", joined.casefold()).split("\n")


def _differ(a: str | None, b: str | None) -> int:
    return -1 if a is None or b is None else int(a != b)


def covered(key: str, parts: list[str]) -> float:
    """The share of ``key`` that is made of whole ``parts``, read from the left with one sign skipped where nothing fits."""
    by_start: dict[str, list[str]] = {}
    for p in sorted({p for p in parts if p}, key=len, reverse=True):
        by_start.setdefault(p[:4], []).append(p)
    at = hit = 0
    while at < len(key):
        for k in (4, 3, 2, 1):
            p = next((p for p in by_start.get(key[at : at + k], ()) if (len(p) > 3 or k == len(p)) and key.startswith(p, at) and (len(p) > 3 or hit or len(p) == len(key))), None)
            if p:
                at += len(p)
                hit += len(p)
                break
        else:
            at += 1
    return hit / max(len(key), 1)


def bare(summary: str) -> str:
    """The summary without label, invisible signs and outer white space."""
    text = summary if summary.isascii() else "".join(c for c in unicodedata.normalize("NFC", summary) if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t\r")
    return LABEL.sub("", text).strip()


def gram_hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def votes(chat: str | None, summary: str | None) -> dict[str, tuple[int, ...]]:
    """Votes of every labelling function but those that need the corpus."""
    text = bare(summary or "")
    key = alnum_key(text)
    letters = any(map(str.isalpha, text))
    short = len(text.split()) <= 3
    empty = (1 if not text else -1 if short else 0, int(key in PLACEHOLDERS or not key), 1 if not letters else -1 if short else 0)
    if not key or key in PLACEHOLDERS or not letters:
        return {"empty": empty, "refusal": (0, 0, 0, 0), "copy": (-1, -1, -1), "language": (-1, -1, -1)}
    said = set(LETTERS.findall(text.lower()))
    first = (not SPEAKERS.isdisjoint(said) or not text.isascii() and "ぁ" <= max(text)) and bool(FIRST_PERSON.search(text))
    own = not OWN_WORDS.isdisjoint(said) and bool(OWN.search(text))
    other = -1 if own else 0  # without the speaker's own voice, missing phrases speak against a refusal
    policy = not POLICY_WORDS.isdisjoint(said) and bool(POLICY.search(text))
    refusal = (int(first), 1 if OPENING.search(text) else other, 1 if policy else other, 1 if first and TASK.search(text) else other)
    messages = lines_of(chat)
    if not messages:
        return {"empty": empty, "refusal": refusal, "copy": (-1, -1, -1), "language": (-1, -1, -1)}
    parsed = [parse_line(m) for m in messages]
    texts = [p[2] for p in parsed]
    joined = "\n".join(texts)
    keys = alnum_keys(joined)
    share = 0.0
    quick = any(len(k) > 3 and (k in key or key in k) for k in keys) or key in keys
    if quick:
        parts = keys + [alnum_key(m) for m in messages] + [alnum_key((p[1] or "") + p[2]) for p in parsed]
        share = covered(key, [*parts, *(alnum_key(p[0]) for p in parsed if p[0]), *(alnum_key(p[1]) for p in parsed if p[1])])
    words = [w.lower() for w in WORD.findall(text)]
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if quick else set()
    inside = 0
    if grams:
        own = [w.lower() for w in WORD.findall(joined)]
        known = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        inside = sum(g in known for g in grams)
    whole = (key in "".join(keys)) if quick else False
    copy = (1 if share >= 0.9 else 0 if share < 0.5 else -1, (1 if inside >= 0.6 * len(grams) else 0 if inside == 0 else -1) if grams else -1, (1 if whole else -1) if quick else 0)
    spoken = by_words(joined)
    language = (1 if _differ(script(text), script(joined)) == 1 else -1, _differ(by_words(text), spoken), _differ(by_signs(text), by_signs(joined) or spoken))
    return {"empty": empty, "refusal": refusal, "copy": copy, "language": language}


def ending(summary: str | None) -> tuple[bool, list[str]]:
    """(closed by punctuation, words of the last sentence)."""
    text = bare(summary or "")
    if alnum_key(text) in PLACEHOLDERS:
        return False, []
    last = [s for s in SENTENCE.split(text) if s.strip()]
    return bool(CLOSED.search(text)), [w.lower() for w in WORD.findall(last[-1])] if last else []


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word n-grams of every sentence of a batch, counted where they close one and where they stand inside one."""
    for batch in it:
        whole: Counter[str] = Counter()
        for s in batch.column(0).to_pylist():
            whole.update(x for x in SENTENCE.split(bare(s)) if x.strip())
        closes: Counter[int] = Counter()
        inside: Counter[int] = Counter()
        for s, n in whole.items():
            words = [w.lower() for w in WORD.findall(s)]
            closed = bool(CLOSED.search(s))
            for end in range(1, len(words) + 1):
                for k in range(1, min(GRAM, end) + 1):
                    h = gram_hash(words[end - k : end])
                    if end < len(words):
                        inside[h] += n
                    elif closed:
                        closes[h] += n
        keys = list(closes.keys() | inside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([closes[k] for k in keys], pa.int64()), pa.array([inside[k] for k in keys], pa.int64())], ["gram", "closes", "inside"])


COLUMNS = ("empty", "refusal", "copy", "language")


def _votes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out: list[list] = [[] for _ in range(4 + len(COLUMNS))]
        for key, chat, summary in zip(*(batch.column(i).to_pylist() for i in range(3))):
            v = votes(chat, summary)
            closed, words = ending(summary)
            grams = [] if closed else [gram_hash(words[-k:]) for k in range(1, min(GRAM, len(words)) + 1)]
            text = bare(summary or "")
            row = [key, closed, grams, int(bool(words) and words[-1] in DANGLING or text[-1:] in tuple(",;:-–—([{«“")), *(list(v[c]) for c in COLUMNS)]
            for o, x in zip(out, row):
                o.append(x)
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int32(), *[pa.list_(pa.int32())] * len(COLUMNS)]
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["pair_id", "closed", "grams", "dangling", *COLUMNS])


def fit(patterns: dict[tuple[int, ...], int], start: float = 0.03, rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for every vote pattern: two classes, votes independent given the class, accuracies with a Beta prior of a twentieth of the rows."""
    if not patterns:
        return {}
    v = np.array(list(patterns), float)
    n = np.array(list(patterns.values()), float)
    voted = v >= 0
    weight = max(4.0, 0.05 * n.sum())
    share, yes, no = start, np.full(v.shape[1], 0.85), np.full(v.shape[1], 0.01)
    post = np.zeros(len(n))
    for _ in range(rounds):
        one = np.log(share) + np.where(voted, np.where(v > 0, np.log(yes), np.log(1 - yes)), 0).sum(1)
        zero = np.log(1 - share) + np.where(voted, np.where(v > 0, np.log(no), np.log(1 - no)), 0).sum(1)
        post = 1 / (1 + np.exp(np.clip(zero - one, -500, 500)))
        a, b = (n * post)[:, None] * voted, (n * (1 - post))[:, None] * voted
        yes = ((a * (v > 0)).sum(0) + 0.85 * weight * share) / (a.sum(0) + weight * share)
        no = ((b * (v > 0)).sum(0) + 0.01 * weight) / (b.sum(0) + weight)
        yes, no = np.clip(yes, 0.05, 0.995), np.clip(no, 0.0005, 0.5)
        share = float(np.clip((n * post).sum() / n.sum(), 1e-4, 0.5))
    return {p: float(x) for p, x in zip(patterns, post)}


def labelled(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(pair_id, defects, posteriors): per pair all defects beyond their cutoffs in the order of DEFECTS, and the posteriors of all five."""
    cut = CUTOFFS | (cutoffs or {})
    spark = pairs.sparkSession
    rows = stored(
        pairs.select("pair_id", "chat", "summary").mapInArrow(_votes, f"pair_id long, closed boolean, grams array<long>, dangling int, {', '.join(f'{c} array<int>' for c in COLUMNS)}"),
        "p1-votes",
    )
    counts = pairs.where("summary IS NOT NULL").select("summary").mapInArrow(_grams, "gram long, closes long, inside long")
    opened = rows.where("NOT closed").select("pair_id", F.posexplode("grams").alias("k", "gram"))
    # A last word may be that of a third of all summaries: such grams are met by broadcast.
    asked = opened.groupBy("gram").agg(F.count("*").alias("uses"))
    counts = stored(counts.groupBy("gram").agg(F.sum("closes").alias("closes"), F.sum("inside").alias("inside")).join(asked, "gram"), "p1-grams")
    seen = hot_joined(opened, counts, ["gram"], "uses", 40).select("pair_id", "k", "closes", "inside")
    best = seen.groupBy("pair_id").agg(
        F.max(F.when(F.col("closes") + F.col("inside") >= KNOWN, F.struct("k", "closes", "inside"))).alias("known"),
        F.max(F.when(F.col("k") == 0, F.col("closes") + F.col("inside"))).alias("word"),
    )
    ratio = F.col("known.closes") / (F.col("known.closes") + F.col("known.inside"))
    rows = rows.join(best, "pair_id", "left").withColumn(
        "truncated",
        F.when(F.col("closed") | (F.size("grams") == 0), F.array(F.lit(0), F.lit(0), F.lit(0)))
        .otherwise(F.array(
            F.when(F.col("known").isNull(), -1).when(ratio < 0.12, 1).when(ratio > 0.3, 0).otherwise(-1),
            F.when(F.coalesce("word", F.lit(0)) == 0, 1).otherwise(-1),
            F.when((F.col("dangling") == 1) & ~F.coalesce(ratio > 0.3, F.lit(False)), 1).otherwise(-1),
        )),
    )
    rows = stored(rows.select("pair_id", *DEFECTS), "p1-patterns")
    for d in DEFECTS:
        patterns = {tuple(r[d]): r["n"] for r in rows.groupBy(d).agg(F.count("*").alias("n")).collect()}
        table = F.create_map(*(x for p, q in fit(patterns).items() for x in (F.lit(",".join(map(str, p))), F.lit(q)))) if patterns else F.lit(None)
        rows = rows.withColumn(f"p_{d}", F.coalesce(F.element_at(table, F.array_join(F.col(d).cast("array<string>"), ",")), F.lit(0.0)) if patterns else F.lit(0.0))
    defects = F.filter(F.array(*(F.when(F.col(f"p_{d}") > cut[d], F.lit(d)) for d in DEFECTS)), lambda x: x.isNotNull())
    return rows.select("pair_id", defects.alias("defects"), F.struct(*(F.round(f"p_{d}", 4).alias(d) for d in DEFECTS)).alias("posteriors"))


def broken(pairs: DataFrame) -> DataFrame:
    """(pair_id, defect): one row per defective summary."""
    return labelled(pairs).where(F.size("defects") > 0).select("pair_id", F.element_at("defects", 1).alias("defect"))
