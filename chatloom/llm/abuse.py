"""Abusive, hateful and sexual messages by maximum-scoring segments of token log-odds.

Tokens and token pairs get log-odds with informative Dirichlet priors: counts come
from a bounded labelled sample, the prior's mean from the counts of the same tokens
over the whole corpus, and seed phrases in several languages enter with a fixed
prior score, which covers wordings that the sample lacks. A linear scan finds every
maximal-scoring segment of a message; Karlin-Altschul statistics of the corpus turn
a segment's score into an expected number of such segments by chance, so scores of
long and short messages compare.

Defined cases: records without messages give no row; messages without known tokens
score 0; labels of null are left out; without any toxic label only the seeds count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.lines import over_records, parse_line
from chatloom.llm.related_splits import ID_FORM, name_key

#: At most this many labelled rows are used, the least label_ids first.
LABELS_MAX = 50_000
#: Weight of the corpus prior in messages, score of a seed, score of a token that isn't known, chance constant, and the expected number of chance hits below which a message counts.
PRIOR, SEED, UNKNOWN, K, CUTOFF = 60.0, 5.0, -0.6, 0.1, 1e-4
#: Messages of the corpus, as a share, beyond which a weak seed loses weight; surroundings of a word in the toxic sample that make it count.
COMMON, SURROUNDINGS = 5e-4, 6
#: Bounds of the fitted decay: within them a strong seed is enough by itself and a weak one that is aimed at nobody isn't.
DECAYS = (2.0, 3.0)
TOXIC = ("abusive", "hateful", "sexual")

# Seed phrases, which count as a whole only. Those of STRONG address or degrade somebody by themselves.
STRONG = (
    # insults
    "fuck you", "fuck your", "fucking idiot", "fucking cretin", "go fuck yourself", "human trash", "human garbage", "waste of oxygen", "inbred pig", "pathetic clown", "pathetic loser", "shut up you", "shut your mouth", "uninstall and never come back", "your mother should have",
    "eres una basura", "basura humana", "hijo de puta", "vete a la mierda", "cállate puta", "maricón de mierda", "ferme ta gueule", "ta gueule", "fils de pute", "va te faire", "halt die fresse", "dreckiger versager", "vai se foder", "filho da puta", "seu lixo", "пошёл нахуй", "иди нахуй", "заткнись",
    # threats and wishes of harm
    "kys", "kill yourself", "hang yourself", "drink bleach", "die in a ditch", "hope you die", "hope you get cancer", "hope he dies", "hope she dies", "gets cancer", "house burns down", "better off dead", "better place without you", "better place once you", "deserve to die", "break your jaw", "slit your throat", "should have aborted you",
    "ojalá te mueras", "te voy a matar", "muérete", "va mourir", "je vais te tuer", "geh sterben", "ich bring dich um", "vou te matar", "сдохни", "я тебя убью",
    # degrading groups
    "subhuman", "less than human", "put them in camps", "belong in the kitchen", "should be gassed", "gas the jews", "untermenschen", "ausländer raus", "sales étrangers", "tu es une merde", "back to your country", "your dirty kind",
    # sexually explicit
    "want to fuck", "send nudes", "suck my dick", "suck my cock", "your tits", "show us your tits", "jerking off to", "sit on my face", "bend over and take it", "blowjob", "cumshot", "fick mich", "geile titten", "enséñame las tetas", "suce ma", "quero te comer", "отсоси",
)
# Those of WEAK have harmless senses too: one counts in full only beside what it is aimed at, else two are needed.
WEAK = {
    "insult": (
        "bitch", "son of a bitch", "asshole", "dumbass", "dumbfuck", "dickhead", "motherfucker", "cunt", "wanker", "prick", "bastard", "scumbag", "moron", "cretin", "retarded", "idiot", "imbecile", "loser", "piece of shit", "waste of space", "inbred", "whore", "slut", "worthless", "useless", "disgusting", "pathetic", "ugly", "stupid", "dumb", "degenerate", "freak", "braindead", "brainless", "filth", "garbage", "coward", "pervert", "creep", "parasite", "vermin", "rat", "lowlife", "scum", "twat", "bellend", "tosser", "arsehole", "shithead", "shitbag", "douchebag", "jackass", "nobody asked", "nobody loves you", "nobody likes you", "pig", "worm", "trash",
        "puta", "pendejo", "gilipollas", "cabrón", "imbécil", "cállate", "connard", "connasse", "salope", "enculé", "arschloch", "hurensohn", "schlampe", "fotze", "wichser", "missgeburt", "schwein", "otário", "vadia", "мудак", "сука", "урод", "тварь", "дебил", "ублюдок", "мусор",
    ),
    "threat": ("kill you", "murder you", "murder your", "kill your", "find you and", "find out where you live", "break your legs", "break your neck", "beat you up", "go die", "die in a fire", "would miss you", "disappeared forever", "once you are in the ground", "better off without you", "thrown you away", "crève", "stirb", "morra", "умри"),
    "group": (
        "are vermin", "are animals", "filthy animals", "are parasites", "be wiped out", "should be wiped", "wipe them out", "the only good", "are dead ones", "do not belong here", "don't belong here", "ship them back", "send them back", "back in crates", "out of our town", "out of our country", "their kind", "dirty kind", "in camps",
        "too stupid to be", "allowed to vote", "carry diseases", "ban every single one of the", "every single one of them", "never share a room with",
    ),
    "sexual": ("huge cock", "horny", "pussy", "rape", "masturbate", "gets so wet", "her ass", "his dick", "jerk off", "naked pics", "naked pictures", "nudes", "lick you", "i will lick", "come to my dm", "bang her", "take your clothes off", "touch yourself", "let us see it"),
}
SEEDS = (*STRONG, *(p for ps in WEAK.values() for p in ps))
# Words that say who is meant, and what takes the sting out: things, moderation.
YOU = frozenset("you your you're youre yours yourself ya u ur tu te ti tus vos eres du dich dir dein deine ihr euch toi ton ta tes vous você voce seu sua ты тебя тебе вы твой".split())
PERSON = frozenset("he she him her his they she's he's streamer someone somebody everybody".split())
GROUPS = frozenset("people women immigrants refugees foreigners migrants jews muslims christians blacks whites asians arabs africans mexicans indians gays lesbians trans disabled cripples elderly".split())
THING = frozenset("this that the these those my our a an another every which".split())
NOBODY = THING | frozenset("it there here what who one".split())
POINTED = frozenset("the this that these those my our his her their and but if when before after until so".split())
MODERATION = frozenset("mods mod moderator moderators moderation automod banned bans banning muted timeout timeouts timed slur slurs filter filtered filters rules rule reported reporting warned warning".split())
# Function words carry no abuse, however rare they are in the corpus.
FUNCTION = frozenset(
    "a an the and or but if then than so as at by for from in into of off on onto out over to up down with without about after before again all any both each few more most other some such no nor not only own same too very can could will would shall should may might must do does did done doing have has had having be am is are was were been being "
    "i you he she it we they me him her us them my your his its our their mine yours this that these those who whom whose which what when where why how here there now just like get gets got go goes come comes take takes put want wants make makes say says said know knows let lets think thinks one ones ever never always still yet once everybody nobody anybody somebody "
    "seriously btw lol lmao honestly man bro yo ngl tbh chat actually literally okay ok wait please pls mean kekw "
    "el la los las de que y en un una por con para del se su al lo le les des et du dans pour qui sur est der die das und ist nicht ein eine zu den dem mit auf für von o os um uma do da no na e и в на с не что по как это".split()
)

WORD = re.compile(r"(?<![\w@/])[^\W\d_]+(?:['’][^\W\d_]+)?(?!\w)")  # no part of a handle
URL = re.compile(r"https?://\S+")
ODD_SIGNS = frozenset("*@$!|0123456789")
ODD = re.compile(r"\b\w[ .\-_]\w[ .\-_]\w\b|\w[.\-]\w|(\w)\1\1")
SPACED = re.compile(r"(?<![\w*])(?:[^\W_](?:[ ]|[.\-_])){2,}[^\W_](?![\w*])")
MASKED = re.compile(r"(?<![\w*])([^\W\d_]{1,8})(\*{1,24})([^\W\d_]{1,8})(?![\w*])")
LEET_WORD = re.compile(r"(?<![\w@])[^\W_0-9]*[0-9@$!|4][\w@$!|]*")
LEET = str.maketrans("013457@$!|9", "oieastasiig")
SPLIT_WORD = re.compile(r"(?<!\w)([^\W\d_]+)[.\-]([^\W\d_]+)(?!\w)")
REPEAT = re.compile(r"(.)\1+")
STRETCH = re.compile(r"([^\W\d_])\1{2,}")


_EDGES = ".,!?;:\"'()[]{}<>«»“”‘’…*-–—"


def words(text: str) -> list[str]:
    """Words that are no part of a handle; the pattern is only needed where a piece isn't all letters."""
    out: list[str] = []
    for w in text.split():
        if w.isalpha():
            out.append(w)
        else:
            w = w.strip(_EDGES)
            if w.isalpha():
                out.append(w)
            elif w:
                out += WORD.findall(w)
    return out


def level(text: str) -> str:
    if text.isascii():
        text = text.lower()
        return URL.sub(" ", text) if "://" in text else text
    text = URL.sub(" ", unicodedata.normalize("NFKC", text).lower())
    return "".join(c for c in text if unicodedata.category(c) != "Cf")


class Spelling:
    """Brings obfuscated words (spaced, split, masked, stretched, with digits for letters) back to words that the model knows as toxic."""

    def __init__(self, phrases: Iterable[str]):
        self.known: dict[str, str] = {}
        self.flat: dict[str, str] = {}
        self.masks: dict[tuple[str, str, int], str] = {}
        for p in sorted(phrases, key=len):
            joined = p.replace(" ", "")
            self.known.setdefault(joined, p)
            self.flat.setdefault(REPEAT.sub(r"\1", joined), p)
            if len(p) > 2:
                self.masks.setdefault((p[0], p[-1], len(p)), p)

    def word(self, w: str) -> str | None:
        return self.known.get(w) or self.flat.get(REPEAT.sub(r"\1", w))

    def plain(self, text: str) -> str:
        def joined(m: re.Match) -> str:
            w = re.sub(r"[ .\-_]", "", m[0])
            k = self.word(w) or self.word(w.translate(LEET))
            if not k and (k := self.word(w[1:])):  # an article of one letter before it
                k = f"{w[0]} {k}"
            return k or m[0]

        def masked(m: re.Match) -> str:
            return self.masks.get((m[1][0], m[3][-1], len(m[0]))) or " maskedword "

        def leet(m: re.Match) -> str:
            w = m[0]
            if w.isdigit():
                return w
            for x in (w.translate(LEET), w.replace("1", "l").translate(LEET)):
                if x.isalpha() and (k := x if x in FUNCTION else self.word(x)):
                    return k
            return w

        if "*" in text:
            text = MASKED.sub(masked, text)
        if ODD.search(text):
            text = SPACED.sub(joined, text)
            text = SPLIT_WORD.sub(lambda m: self.word(m[1] + m[2]) or m[0], text)
        if not ODD_SIGNS.isdisjoint(text):
            text = LEET_WORD.sub(leet, text)
        return text if not STRETCH.search(text) else re.sub(r"[^\W\d_]+", lambda m: (self.word(m[0]) or STRETCH.sub(r"\1", m[0])) if STRETCH.search(m[0]) else m[0], text)


def units(tokens: list[str]) -> Iterator[str]:
    """Tokens and neighbouring pairs."""
    yield from tokens
    for a, b in zip(tokens, tokens[1:]):
        yield f"{a} {b}"


def _near(tokens: list[str], k: int) -> tuple[str, str]:
    return tokens[k - 1] if k else "", tokens[k + 1] if k + 1 < len(tokens) else ""


class Model:
    """Scores of units; tokens that are no units of the sample or the seeds score UNKNOWN.

    A unit's log-odds compare its rate in toxic messages with its rate in the corpus,
    which is benign but for a small share, so toxic-only units reach the logarithm of
    that share's inverse and common words 0. A word earns a full score only if the
    sample shows it in several surroundings: one wording, however often repeated, says
    little about its single words. It still tells itself by its neighbouring pairs.
    Function words score nothing. A weak seed that is frequent in the corpus is harmless
    there.
    """

    def __init__(self, labelled: list[tuple[str, str]], background: dict[str, int], spelling: Spelling):
        toxic, benign = Counter(), Counter()
        around: dict[str, set[str]] = {}
        for message, label in labelled:
            tokens = words(spelling.plain(level(message)))
            (toxic if label in TOXIC else benign).update(set(units(tokens)))
            if label in TOXIC:
                for k, t in enumerate(tokens):
                    for side, x in zip("<>", _near(tokens, k)):
                        around.setdefault(t, set()).add(side + x)
        calm_text = [f" {' '.join(words(spelling.plain(level(m))))} " for m, y in labelled if y not in TOXIC]
        n_t, n_b = sum(label in TOXIC for _, label in labelled), sum(label not in TOXIC for _, label in labelled)
        n_c = max(1, background.get("", 1))
        self.phrases: dict[str, list[tuple[tuple[str, ...], float, str]]] = {}
        for kind, ps in (("", STRONG), *WEAK.items()):
            for phrase in ps:
                t = tuple(words(phrase))
                harmless = sum(f" {' '.join(t)} " in c for c in calm_text)
                often = max(0, min(background.get(u, 0) for u in units(list(t))) - 20) / n_c  # a few prove nothing
                weight = SEED / (1 + harmless) * (1.0 if not kind or often <= COMMON else COMMON / often)
                self.phrases.setdefault(t[-1], []).append((t, weight, kind))
        self.scores: dict[str, float] = {}
        sure = sorted((background.get(u, 0) + 0.5) / (n_c + 1) / (n / n_t) for u, n in toxic.items() if n > 2 and not benign[u] and " " not in u and u not in FUNCTION)
        most = math.log(1 / min(0.2, max(1e-4, sure[len(sure) // 2]))) if sure else 1.0
        for u in toxic.keys() | benign.keys():
            corpus = (background.get(u, 0) + 0.5) / (n_c + 1)
            p_t = (toxic[u] + PRIOR * corpus) / (n_t + PRIOR)
            p_c = (benign[u] + PRIOR * corpus) / (n_b + PRIOR)
            odds = math.log(p_t / max(p_c, corpus * 0.5))
            sd = math.sqrt(1 / (toxic[u] + 0.5) + 1 / (benign[u] + min(background.get(u, 0), 50) + 0.5))
            odds *= abs(odds) / (abs(odds) + sd)
            pure = min(1.0, max(0.0, 2 * odds / most - 0.6))  # 0 where most of the corpus' uses are harmless
            parts = u.split(" ")
            if len(parts) > 1:
                top = 0.0 if toxic[u] < 2 else 0.5 if FUNCTION.issuperset(parts) else 1.0
                self.scores[u] = pure * top if odds > 0 else max(-3.0, 0.6 * odds)
            elif u in FUNCTION:
                self.scores[u] = -0.2
            else:
                top = 0.0 if toxic[u] < 2 else 1.5 if len(around.get(u, ())) >= SURROUNDINGS else 0.2
                self.scores[u] = pure * top - 0.2 if odds > 0 else max(-3.0, odds - 0.3)
        self.scores["maskedword"] = 1.5
        self.groups = GROUPS | {u for u, x in self.scores.items() if x > 1 and u.endswith("s") and benign[u] == 0 and u not in self.phrases}
        self.hot = frozenset(u.split(" ")[-1] for u, s in self.scores.items() if s > 0) | self.phrases.keys()
        self.decay = self._decay(background)

    def _decay(self, background: dict[str, int]) -> float:
        """The positive root of E[exp(decay x score)] = 1 over the corpus' tokens: how fast chance scores thin out."""
        dist = [(n, self.scores.get(u, UNKNOWN)) for u, n in background.items() if u and " " not in u] or [(1, UNKNOWN)]
        total = sum(n for n, _ in dist)
        if not any(s > 0 for _, s in dist) or sum(n * s for n, s in dist) >= 0:
            return DECAYS[0]
        low, high = 1e-6, 50.0
        for _ in range(80):
            mid = (low + high) / 2
            if sum(n / total * math.exp(min(mid * s, 600)) for n, s in dist) > 1:
                high = mid
            else:
                low = mid
        return min(max(low, DECAYS[0]), DECAYS[1])

    def aimed(self, tokens: list[str], end: int, size: int, kind: str) -> bool:
        """Is the seed of ``size`` tokens before ``end`` aimed at somebody?"""
        met = set(tokens)
        you = not YOU.isdisjoint(met)
        near = tokens[max(0, end - size - 5) : end - size]
        if kind == "group":
            return not self.groups.isdisjoint([*near, *tokens[end : end + 5]])
        if kind == "threat":
            return you and not {"i", "i'll", "i'm", "we", "we'll", "gonna", "someone", "somebody", "hope", "nobody", "should"}.isdisjoint(near) or end == size
        if kind == "sexual":
            return you or not {"i", "i'd", "i'll", "i'm"}.isdisjoint(met)
        before = tokens[max(0, end - size - 4) : end - size]
        for k in range(len(before) - 1, -1, -1):
            if before[k] in ("is", "are", "was", "were", "you're", "he's", "she's", "i'm", "am"):
                subject = before[:k]
                if before[k] in ("i'm", "am"):
                    return False
                if before[k] in ("is", "was"):  # a handle is no token, so its place is empty
                    return not subject or subject[-1] in PERSON or subject[-1] not in NOBODY and (len(subject) == 1 or subject[-2] not in THING)
                break
        spoken = max((k for k, t in enumerate(near) if t in YOU), default=-1)
        return spoken >= 0 and POINTED.isdisjoint(near[spoken + 1 :]) or end < len(tokens) and tokens[end] in YOU or len(tokens) <= 3

    def seeds_in(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the seeds in a message that don't overlap, the heaviest first. Two weak ones of a kind confirm each other."""
        hits = [(w, i + 1 - len(p), i + 1, kind) for i, t in enumerate(tokens) if t in self.phrases for p, w, kind in self.phrases[t] if tuple(tokens[max(0, i + 1 - len(p)) : i + 1]) == p]
        if not hits:
            return []
        last: dict[str, int] = {}
        apart: Counter[str] = Counter()
        for _, a, b, kind in sorted(hits, key=lambda h: h[2]):
            if a >= last.get(kind, 0):
                apart[kind] += 1
                last[kind] = b
        mild = 0.3 if not MODERATION.isdisjoint(tokens) else 1.0
        weighed = [(mild * w * (1.0 if not kind or apart[kind] > 1 or self.aimed(tokens, b, b - a, kind) else 0.35), a, b) for w, a, b, kind in hits]
        out: list[tuple[int, int, float]] = []
        for w, a, b in sorted(weighed, key=lambda h: (-h[0], h[1] - h[2], h[1])):
            if all(b <= x or y <= a for x, y, _ in out):
                out.append((a, b, w))
        return out

    def token_scores(self, tokens: list[str]) -> list[float]:
        get = self.scores.get
        out: list[float] = []
        met: set[str] = set()
        before = ""
        for t in tokens:
            score = get(t, UNKNOWN)
            if t in met:  # a token says as much once as many times
                score = min(UNKNOWN, score)
            else:
                met.add(t)
                if score != UNKNOWN and before:
                    score += get(f"{before} {t}", 0.0)
            out.append(score)
            before = t
        for a, b, w in self.seeds_in(tokens):  # a seed stands for what the sample says of its words
            out[a:b] = [*[0.0] * (b - a - 1), w]
        return out

    def strength(self, score: float, length: int) -> float:
        """-log10 of the expected number of chance segments with this score in a message of this length."""
        return -(math.log(K * max(length, 1)) - self.decay * score) / math.log(10) if score > 0 else 0.0


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), left to right, in linear time."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        end, right = i + 1, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def message_strength(text: str, model: Model, spelling: Spelling) -> float:
    """Strength of the strongest toxic passage of a message, 0 without one."""
    low = level(text)
    tokens = words(low)
    if not ODD_SIGNS.isdisjoint(low) or ODD.search(low):
        again = words(spelling.plain(low))
        if again != tokens:
            tokens = again
    if model.hot.isdisjoint(tokens):
        return 0.0
    best = max((s for _, _, s in segments(model.token_scores(tokens))), default=0.0)
    return max(0.0, model.strength(best, len(tokens)))


class Remembered:
    """A function of a text with its last results kept: most messages of a chat occur many times."""

    def __init__(self, f: Callable, size: int = 150_000):
        self.f, self.size, self.kept = f, size, {}

    def __call__(self, text: str):
        out = self.kept.get(text)
        if out is None:
            if len(self.kept) >= self.size:
                self.kept.clear()
            out = self.kept[text] = self.f(text)
        return out


def trained(tables: list[tuple[str, DataFrame, str, str]], labels: DataFrame) -> tuple[Model, Spelling]:
    """The model: labelled sample (bounded) on the driver, corpus counts of its units (bounded by the sample's and seeds' vocabulary) in one pass."""
    rows = [(r["message"], r["label"]) for r in labels.where("message IS NOT NULL AND label IS NOT NULL").orderBy("label_id").limit(LABELS_MAX).collect()]
    toxic_only = Counter(w for m, y in rows if y in TOXIC for w in set(words(level(m))))
    harmless = {w for m, y in rows if y not in TOXIC for w in words(level(m))}
    spelling = Spelling([*(s for s in SEEDS if len(words(s)) <= 3), *(w for s in SEEDS for w in words(s) if len(w) > 3), *(w for w, n in toxic_only.items() if n > 1 and len(w) > 3 and w not in harmless)])
    vocabulary = frozenset(u for m, _ in rows for u in units(words(spelling.plain(level(m))))) | {u for s in SEEDS for u in units(words(s))}

    def units_of(text: str) -> tuple[str, ...]:
        t = words(level(text))
        return (*vocabulary.intersection(t), *vocabulary.intersection(map(" ".join, zip(t, t[1:]))))

    units_in = Remembered(units_of)

    def counted(_key: int, messages: list[str]) -> Iterator[tuple]:
        c: Counter[str] = Counter()
        for m in messages:
            c.update(units_in(parse_line(m)[2]))
        c[""] += len(messages)
        yield from c.items()

    counts = over_records(tables, counted, "unit string, n long", [("unit", pa.string()), ("n", pa.int64())])
    background = {r["unit"]: r["n"] for r in counts.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    return Model(rows, background, spelling), spelling


def scored(tables: list[tuple[str, DataFrame, str, str]], labels: DataFrame) -> DataFrame:
    """(tbl, rec_id, score, worst_line, n_messages, n_flagged) of every record with messages.

    score: -log10 of the expected chance hits as strong as the record's strongest
    passage; a message counts as flagged where that number is under CUTOFF.
    """
    model, spelling = trained(tables, labels)
    least = -math.log10(CUTOFF)
    strength = Remembered(lambda text: message_strength(text, model, spelling))

    def rows(key: int, messages: list[str]) -> Iterator[tuple]:
        best, line, flagged = 0.0, None, 0
        for i, m in enumerate(messages):
            s = strength(parse_line(m)[2])
            if s > best:
                best, line = s, i + 1
            flagged += s >= least
        yield key, round(best, 6), line, len(messages), flagged

    return over_records(tables, rows, "rec_id long, score double, worst_line long, n_messages long, n_flagged long", [("rec_id", pa.int64()), ("score", pa.float64()), ("worst_line", pa.int64()), ("n_messages", pa.int64()), ("n_flagged", pa.int64())])


def flagged(tables: list[tuple[str, DataFrame, str, str]], labels: DataFrame) -> DataFrame:
    """(tbl, rec_id) of records with at least one flagged message."""
    return scored(tables, labels).where("n_flagged > 0").select("tbl", "rec_id")


def rates(tables: list[tuple[str, DataFrame, str, str]], labels: DataFrame, channel: dict[str, str]) -> DataFrame:
    """(tbl, channel, records, flagged, rate) by the channel's name key of file_name or id; records without messages count as not flagged."""
    hits = scored(tables, labels).select("tbl", "rec_id", (F.col("n_flagged") > 0).cast("int").alias("hit"))
    parts = []
    for name, df, key, _ in tables:
        c = F.col(channel[name])
        source = name_key(F.regexp_replace(c, r"(?i)\.json\s*$", "")) if name == "moment_data" else F.when(c.rlike(ID_FORM), name_key(F.regexp_extract(c, ID_FORM, 1)))
        parts.append(df.select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), F.coalesce(source, F.lit("unknown")).alias("channel")))
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.union(p)
    return keys.join(hits, ["tbl", "rec_id"], "left").groupBy("tbl", "channel").agg(F.count("*").alias("records"), F.coalesce(F.sum("hit"), F.lit(0)).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("records"), 6))
