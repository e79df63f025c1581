"""Moments: filtered messages, tones, concepts, surface phrases, topics and templated summaries of each window.

Everything that is counted inside a moment comes from one Arrow pass over its row;
nothing is shuffled. Defined cases: null structs, lists and elements are skipped; a
moment without messages is chaotic and has no topic; copied moments each give a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import rows as R
from chatloom.functions import text as T

TONE_ORDER = ("laughter", "hype", "approval", "confusion", "frustration")
_FIELDS = {
    "moment_id": ("long", pa.int64()), "file_name": ("string", pa.string()), "window_id": ("string", pa.string()), "messages": ("array<string>", pa.list_(pa.string())), "keys": ("array<string>", pa.list_(pa.string())),
    **{k: ("double", pa.float64()) for k in TONE_ORDER}, "counts": ("map<string,long>", pa.map_(pa.string(), pa.int64())), "call_name": ("string", pa.string()), "person": ("string", pa.string()),
    "phrase": ("string", pa.string()), "n": ("long", pa.int64()),
}
_IN = ("moment_id", "file_name", "window_id", "messages", "extractive_summary.key_messages")


def messages(moments: DataFrame) -> DataFrame:
    """(moment_id, file_name, window_id, messages, keys): filtered and normalised texts, key lines apart."""

    def run(key, file, window, raw, keys):
        yield key, file, "x" if window is None else window, R.moment_messages(raw), R.moment_keys(keys)

    return _pass(moments, run, list(_FIELDS)[:5])


def profile(moments: DataFrame) -> DataFrame:
    """``messages`` with five tone scores, counts of every concept found, the name called and the person named most, and the best phrase with its messages; key lines count like messages."""

    def run(key, file, window, raw, keys):
        said, marked = R.moment_messages(raw), R.moment_keys(keys)
        combined = said + marked
        counts, call, person = R.concepts(combined)
        yield key, file, "x" if window is None else window, said, marked, *R.tone_scores(combined), list(counts.items()), call, person, *(R.best_phrase(R.moment_phrases(combined)) or (None, None))

    return _pass(moments, run, list(_FIELDS))


def _pass(moments: DataFrame, run, names: list[str]) -> DataFrame:
    return R.over_rows(moments.select(*_IN), run, ", ".join(f"{n} {_FIELDS[n][0]}" for n in names), [(n, _FIELDS[n][1]) for n in names])


def phrases(moments: DataFrame) -> DataFrame:
    """(moment_id, phrase, n): words, word pairs and triples that can stand for a topic, by the number of messages with them."""

    def run(key, file, _window, raw, keys):
        for p, n in R.moment_phrases(R.moment_messages(raw) + R.moment_keys(keys), L.ALIASES.get((file or "").lower(), ())).items():
            yield key, p, n

    return _pass(moments, run, ["moment_id", "phrase", "n"])


def tones(scores: DataFrame, *keep: str) -> DataFrame:
    """(moment_id, tone, secondary) and what is to be kept: the leading tone; ``mixed`` has both leaders as secondary."""
    order = F.array_sort(F.array(*(F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(TONE_ORDER))))
    df = scores.select("moment_id", *keep, order.alias("o")).select("moment_id", *keep, F.col("o")[0].alias("a"), F.col("o")[1].alias("b"))
    a, b = -F.col("a.s"), -F.col("b.s")
    mixed, beside = (b >= 2.4) & (b >= a * 0.78), (b >= 2.8) & (b >= a * 0.6)
    return df.select(
        "moment_id",
        *keep,
        F.when(a < 2.2, "chaotic").when(mixed, "mixed").otherwise(F.col("a.k")).alias("tone"),
        F.when(a < 2.2, F.lit(None)).when(mixed, F.concat_ws(",", "a.k", "b.k")).when(beside, F.col("b.k")).alias("secondary"),
    )


def cased(phrase: Column) -> Column:
    """Words of more than three letters capitalised, short ones upper only if listed."""
    word = lambda w: F.when(F.length(w) > 3, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))).when(w.isin(*L.SHORT_OK), F.upper(w)).otherwise(w)
    return F.array_join(F.transform(F.split(phrase, " "), word), " ")


def topics(profiled: DataFrame) -> DataFrame:
    """(moment_id, topic, kind): the first concept rule that holds, else the best phrase, else the host where named; null if none. From ``profile``."""
    df = profiled.select("*", F.lower("file_name").alias("file"), F.lower(F.array_join("messages", " ")).alias("said"))
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    aliases = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in L.ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("file")), F.array().cast("array<string>"))
    topic = kind = None
    for needs, name, what in L.TOPIC_RULES:
        hit = None
        for k, least in needs:
            hit = n(k) >= least if hit is None else hit & (n(k) >= least)
        value = F.replace(F.lit(name), F.lit("{call}"), F.initcap(F.coalesce("call_name", F.lit("")))) if "{call}" in name else F.lit(name)
        topic = F.when(hit, value) if topic is None else topic.when(hit, value)
        kind = F.when(hit, what) if kind is None else kind.when(hit, what)
    good = F.col("phrase").isNotNull() & ~F.array_contains(aliases, F.col("phrase"))
    host = F.exists(aliases, lambda a: F.col("said").contains(a))
    return df.select(*profiled.columns, topic.when(good, cased(F.col("phrase"))).when(host, "{streamer}").alias("topic"), kind.when(good, "phrase").when(host, "entity").alias("kind"))


# Our own wording; the contract is which of them is used, and between 20 and 55 words.
TOPIC_TEXTS = {
    "the cat and Christmas tree bit": ("Viewers jump from the cat to the tree that is still standing and rib {streamer} about both of them in turn.", "Two jokes run side by side here: a cat that steals every shot, and a Christmas tree nobody took down."),
    "the bazooka kill": ("One bazooka shot ends it at once, and the messages answer with shouting, disbelief and a long run of jokes.", "The bazooka hit lands like a punch line, and viewers keep laughing at how sudden and total it was."),
    "the BULLSHIT chant": ("A chant of BULLSHIT fills the window; hardly anybody takes the scene for real, and most enjoy saying so.", "Line after line calls BULLSHIT on what is shown, half as a protest and half as a joke that grows."),
    "someone getting killed": ("A death out of nowhere sets off shock and laughter in equal parts, and the lines come thick and fast.", "Viewers watch somebody drop in an instant and answer with panic, disbelief and a good deal of laughter."),
    "the clown-car visual": ("The tiny car with far too much in it becomes the joke of the window, and everybody adds a line.", "What looks like a clown car draws one joke after the other about its size and its passengers."),
    "the ALERT slur joke": ("A word that may have been a slur turns into an ALERT joke, repeated with mockery until it carries the window.", "Viewers sound a mock ALERT over one doubtful word and keep that joke alive through most of the window."),
    "the weird gibberish bit": ("Strange words and made-up sounds take over, and viewers pass them on, more amused than sure what they mean.", "The gibberish catches on at once: lines repeat it, bend it and laugh at it without making sense of it."),
    "how rancid the vibes are": ("The air is called rancid and toxic from all sides, with open criticism and mockery in the same lines.", "Viewers agree that the vibes have gone bad and say so again and again, some amused, some annoyed."),
    "the Throop town-name riff": ("The name Throop is enough for a whole thread of small jokes, each one turning the word a little further.", "A town called Throop keeps viewers happy: they repeat the name, play with it and ask for more."),
    "the Scranton and Office jokes": ("Scranton comes up and jokes from The Office follow at once, light in tone and known to everybody.", "References to Scranton and The Office pass back and forth as an easy joke that most of them share."),
    "the geography guess": ("A guess on the map brings corrections from those who know better and jokes from those who don't mind.", "Viewers argue over where the place is, with exact corrections in one line and plain mockery in the next."),
    "the game list": ("The list of games is taken apart entry by entry, with objections, favourites of their own and second thoughts.", "Hardly an entry of the list goes by without protest, and rival rankings fill most of this window."),
    "the stream ending": ("Good nights and kind words take over as the stream comes to its end, and the mood stays warm.", "Viewers take their leave, many of them with love and thanks, and the window closes on a soft note."),
    "the spoilers": ("Spoilers turn up and split the lines: some want them gone at once, others find the fuss rather funny.", "Leaked details annoy a good part of the viewers, who ask for silence while a few go on joking."),
    "the driving": ("The driving is judged without mercy, turn after turn, as something that hurts to look at.", "Every corner brings new criticism and new jokes, and nobody has a kind word for the driving."),
    "the bad teamplay": ("Blame goes round for the teamplay: bad calls, bait and silence on the comms are named one by one.", "The team gets little mercy, and complaints about bait and missing calls fill most of the window."),
    "the argument": ("An argument draws the viewers in, and they take sides, provoke and joke more than they share one view.", "Back and forth it goes, with bait, blame and jokes, and no reaction that all of them would share."),
}
KIND_TEXTS = {
    "entity": {
        "laughter": "{topic} is what everybody laughs about here, and one line after the other makes a joke of it.",
        "hype": "{topic} raises the energy of this window, and viewers keep pushing it higher with every line.",
        "approval": "{topic} is received with warmth, and the lines about it stay friendly and a little playful.",
        "confusion": "{topic} leaves viewers at a loss, and they go on asking what it is that they see.",
        "frustration": "{topic} gets on the viewers' nerves, and criticism comes back in line after line.",
    },
    "phrase": {
        "laughter": "{topic} is repeated as a joke that needs no context, and laughter is the main answer to it.",
        "hype": "{topic} is shouted again and again, with all the excitement of a win that is about to come.",
        "confusion": "{topic} keeps coming back in the lines, yet what to think of it stays open to the end.",
        "frustration": "{topic} is what viewers hold on to, and they do so with annoyance and little patience.",
    },
}
MIXED_TEXTS = ("Opinions on {topic} part ways, with {pair} and no line that all would sign.", "Viewers part ways here, with {pair} and no subject that they share.")
TONE_TEXTS = {
    "laughter": "{topic} is good for joke after joke, and viewers treat it as something that can't be serious.",
    "hype": "{topic} has viewers excited, and they answer with energy and without a second thought.",
    "approval": "{topic} is met with approval for the most part, and the lines stay kind across the window.",
    "confusion": "{topic} puzzles the viewers, who try to work out what is going on while the lines pile up.",
    "frustration": "{topic} goes down badly with most viewers, and complaints outnumber any kind of support.",
    "chaotic": "{topic} is somewhere in the middle of it all, between jokes, asides and reactions that go in all directions.",
}
NO_TOPIC_TEXTS = {
    "laughter": ("Whatever happened, it was funny, and viewers add joke after joke to it.", "Most lines laugh about something that landed as a plain absurdity."),
    "hype": ("Excitement carries the window, though the lines alone don't tell what it is about.", "The lines are loud and glad, more than any one subject would explain."),
    "approval": ("Viewers are content and say so, without naming one subject for it.", "A kind tone runs through the lines, whatever they may be about."),
    "confusion": ("Nobody is sure what has just happened, and questions make up most of the lines.", "Puzzled lines follow one another, and none of them settles the matter."),
    "frustration": ("Annoyance speaks from most lines, though its cause can't be made out.", "Criticism prevails here, and little else gets a hearing."),
    "chaotic": ("Jokes, asides and single reactions mix here, and no subject holds them together.",),
}
PAIRS = {"confusion,laughter": "disbelief and laughter at once", "frustration,laughter": "mockery with an edge", "confusion,hype": "excitement and confusion at once", "approval,confusion": "support and doubt at once", "approval,frustration": "approval and criticism side by side"}
# Said of a second tone where the topic is no bit, event or mood: by "tone,secondary".
SECOND = {
    "laughter,confusion": " Confusion runs through it as a second thread.", "confusion,laughter": " Much of that confusion ends in laughter.", "frustration,laughter": " Part of the criticism is plainly meant as a joke.",
    "approval,confusion": " Some of them still aren't sure what they approve of.", "hype,confusion": " A few are excited and lost at the same time.",
}
# Added to summaries under 20 words: first by the second tone, then by the tone.
PAD_SECOND = {
    "laughter": (" Some laugh their way through it all the same.", " A few lines are more puzzled than amused."), "confusion": (" Being baffled and being amused go together here.", " Certainty is hard to find in these lines."),
    "frustration": (" The annoyance can't be missed.", " Complaints come through clearly."), "approval": (" There is goodwill beneath it.", " On balance the mood stays on the kind side."), "hype": (" The energy points upward throughout.", " Excitement still fills many of the lines."),
}
PAD_TONE = {
    "laughter": (" Everybody piles onto the joke for as long as it lasts.", " The mood is amused, with a little malice in it."), "confusion": (" Nobody sounds sure of what there was to see.", " Questions outnumber answers from the first line to the last."),
    "frustration": (" Complaints do most of the talking from start to end.", " The negative voices have this window to themselves."), "approval": (" Support outweighs doubt for as long as it lasts.", " The reactions stay warm from the first line to the last."),
    "hype": (" The energy is high from the first line to the last.", " It stays loud and glad for the whole window."), "chaotic": (" The reactions never settle into one direction for long.", " Nobody stays with one reaction for more than a line."),
}
#: Topics whose jokes are told with a straight face: annoyed or puzzled lines count as the second tone.
DEADPAN = ("the Throop town-name riff", "the Scranton and Office jokes")


def streamerized(c: Column) -> Column:
    """Known host names replaced by one placeholder."""
    return F.regexp_replace(F.regexp_replace(c, f"(?i)(?U){L.HOST_NAMES}", "{streamer}"), r"\{streamer\}(?:\s+\{streamer\})+", "{streamer}")


def summary_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\{streamer\}|[A-Za-z0-9']+"))


def pair_tone(secondary: Column) -> Column:
    """Wording for two tones that lead together, whatever their order."""
    names = F.array_sort(F.split(secondary, ","))
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in PAIRS.items() for x in kv)), F.array_join(names, ","))
    return F.coalesce(known, F.array_join(F.split(secondary, ","), " mixed with "))


def _by(table: dict, key: Column) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), value(v)))), key)


def _seed(c: Column) -> Column:
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, 8), 16, 10).cast("long")


def _pick(options: Column, seed: Column) -> Column:
    return F.try_element_at(options, (F.pmod(seed, F.size(options)) + 1).cast("int"))


def summaries(moments: DataFrame) -> DataFrame:
    """(moment_id, tone, secondary, topic, kind, summary): a templated summary, its wording chosen by a hash of file and window."""
    df = topics(profile(moments))
    df = tones(df, "file_name", "window_id", "topic", "kind")
    tone, second, topic, kind = (F.col(c) for c in ("tone", "secondary", "topic", "kind"))
    deadpan = topic.isin(*DEADPAN) & tone.isin("frustration", "confusion")
    df = df.withColumns({"secondary": F.when(deadpan, tone).otherwise(second), "tone": F.when(deadpan, "laughter").otherwise(tone)})
    seed = _seed(F.concat_ws(":", F.coalesce("file_name", F.lit("")), "window_id"))
    mixed = F.when(tone == "mixed", F.replace(F.when(topic.isNotNull(), MIXED_TEXTS[0]).otherwise(MIXED_TEXTS[1]), F.lit("{pair}"), pair_tone(second)))
    text = F.coalesce(
        _pick(_by(TOPIC_TEXTS, topic), seed), *(F.when(kind == k, _by(texts, tone)) for k, texts in KIND_TEXTS.items()), mixed, F.when(topic.isNotNull(), _by(TONE_TEXTS, tone)), _pick(_by(NO_TOPIC_TEXTS, tone), seed)
    )
    text = F.concat(F.upper(F.substring(text := F.replace(text, F.lit("{topic}"), F.coalesce(topic, F.lit(""))), 1, 1)), F.substring(text, 2, 1 << 20))
    beside = F.when((tone != "mixed") & topic.isNotNull() & ~kind.isin("bit", "event", "mood"), _by(SECOND, F.concat_ws(",", tone, second)))
    df = T.computed(df, "moment_id", "tone", "secondary", "topic", "kind", s=streamerized(T.squeeze(F.concat(text, F.coalesce(beside, F.lit(""))))))
    seed, single = _seed(F.col("s")), F.when(tone != "mixed", second)
    short = lambda c, pad: F.when(summary_words(c) < 20, F.concat(c, F.coalesce(pad, F.lit("")))).otherwise(c)
    padded = short(short(F.col("s"), _pick(_by(PAD_SECOND, single), seed)), _pick(_by(PAD_TONE, F.when(tone == "mixed", "chaotic").otherwise(tone)), seed))
    df = T.computed(df, "moment_id", "tone", "secondary", "topic", "kind", s=padded)
    whole = F.when((summary_words(F.col("s")) > 55) & F.col("s").contains(". "), F.concat(F.substring_index("s", ". ", 1), F.lit("."))).otherwise(F.col("s"))
    cut = F.regexp_extract(whole, r"^((?:[^A-Za-z0-9']*[A-Za-z0-9']+){55})", 1)
    return df.select("moment_id", "tone", "secondary", "topic", "kind", F.when(summary_words(whole) > 55, F.concat(cut, F.lit("."))).otherwise(whole).alias("summary"))


def preview(c: Column, most: int = 180) -> Column:
    """The first characters of a text, with dots where there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def rewritten(moments: DataFrame) -> DataFrame:
    """The moments with their abstractive summary replaced; ``moment_id`` must be unique. To be written to a new place."""
    return moments.join(summaries(moments).select("moment_id", "summary"), "moment_id").withColumn("abstractive_summary", F.struct("summary")).drop("summary")
