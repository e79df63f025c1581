"""Personal information in free text: anchors found by an Aho-Corasick automaton, expanded and validated by local parsers.

One automaton pass over the texts of a record finds at-signs, pairs of digits,
address words, titles and introducing phrases, each with its position. A parser of the
anchor's kind expands from there to the left and to the right, over a bounded stretch of
the same message, and validates what lies between; nothing else of a message is looked
at. A name also shows beside another case ("X then 07700 900123"), which is its anchor.

Defined cases: records without messages give no rows; user handles, times, scores,
seeds, versions, coordinates and item codes are no cases; a name needs a title or
an introducing phrase beside its shape, so games' characters don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from chatloom.llm.lines import over_records, parse_line

KINDS = ("email", "phone", "id_number", "address", "name")
EMAIL, PHONE, ID, ADDRESS, NAME = range(5)
PLACEHOLDERS = tuple(f"<{k.upper()}>" for k in KINDS)

# Anchors and the words the parsers rely on.
AT_SIGNS = ("@", "(at)", "[at]", "{at}")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "drive", "lane", "ln", "boulevard", "blvd", "court", "ct", "terrace", "close", "crescent", "square", "way")
BEFORE_NAMES = ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée")  # a number, the word, a name
ENDINGS = ("strasse", "straße", "gasse", "allee", "platz")  # a name, the ending, a number
BEFORE_NUMBERS = ("calle", "avenida", "plaza", "paseo", "rua", "via")  # the word, a name, a number
SPACES = "\t\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000"
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "señor", "señora", "mme", "monsieur", "madame", "г-н", "г-жа")
LEADS = (
    "name is", "name's", "named", "i am called", "teacher", "neighbor", "neighbour", "colleague", "coworker", "landlord", "signed", "sincerely", "regards", "work with", "works with", "worked with", "live with", "lives with",
    "greetings from", "greeting from", "on cam is", "ask for", "dear",  "mi nombre es", "me llamo", "je m'appelle", "mon nom est", "ich heisse", "ich heiße", "mein name ist", "meu nome é", "меня зовут",
)
PERSONS = ("guy", "girl", "man", "woman", "person", "dude", "kid")
TAILS = ("from my school", "from our school", "from my work", "from my office", "from my class", "from my street", "said hi", "says hi")
STREETS = rf"(?:{'|'.join(STREET_WORDS)})"
NOT_NAMES = frozenset("a an the my your his her our their this that these those he she it we they you i and or but then with from in on at to of for is was are has have not no so all every who what when where".split())
CHARACTERS = frozenset("sir captain baron baroness queen king prince princess lord lady mother father brother sister doctor iron old count duke saint aunt auntie uncle general admiral grand great dark the chat".split())
NOT_STREETS = NOT_NAMES | frozenset("take left right next last first so too more points times left coins keys hours minutes months viewers only just level".split())
WORDS = re.compile(r"[^\W\d_]+")
NO_PHONE = re.compile(r"\b(?:score|points|seed|coins|coordinates|code|build|version|record|bits|id is)\b")

W = r"[^\W\d_]"
S, O = " {1,3}", " {0,3}"  # a gap, and an optional one
DOT = rf"(?:\.|{O}[\[({{]{O}dot{O}[\])}}]{O}|{S}dot{S})"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
LOCAL = re.compile(r"(?<![a-z0-9_])[a-z0-9_](?:[a-z0-9_.+%-]{0,62}[a-z0-9_])?\Z")
DOMAIN = re.compile(rf"{LABEL}(?:{DOT}{LABEL})*{DOT}[a-z]{{2,24}}\b")
DOMAIN_WORDS = re.compile(rf"{S}{LABEL}(?:{S}dot{S}{LABEL})*{S}dot{S}[a-z]{{2,24}}\b")
NUMERIC = frozenset("0123456789 +-.()")
PHONES = re.compile(
    rf"(?<![\w.+-])(?:\+\d{{1,3}}(?:(?:{S}|[.-])?\(?\d{{1,5}}\)?){{2,6}}|00\d{{2}}(?:{S}|[.-])?\d{{2,4}}(?:{S}|[.-])?\d{{5,9}}|\(\d{{3}}\){O}\d{{3}}(?:{S}|[.-])\d{{4}}|\d{{3}}([.-])\d{{3}}\1\d{{4}}|\d{{3}}{S}\d{{3}}{S}\d{{4}}"
    rf"|0\d{{4}}{S}\d{{3}}{O}\d{{3}}|0\d(?:(?:{S}|[.-])\d{{2}}){{4}}|0\d{{9,10}}|\d{{10}}|\d{{11}})(?![\w-]|[.:]\d)"
)
IDS = re.compile(
    rf"(?<![\w.+-])(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}{S}\d{{2}}{S}\d{{4}}|[a-z]{{2}}{O}\d{{2}}{O}\d{{2}}{O}\d{{2}}{O}[a-d]|\d{{8}}-?[a-z]|[xyz]-?\d{{7}}-?[a-z]|[cfghjklmnprtvwxyz]\d{{2}}[cfghjklmnprtvwxyz0-9]\d{{5}}"
    rf"|\d{{4}}(?:(?:{S}|-)\d{{4}}){{2,3}}(?:(?:{S}|-)\d{{1,3}})?|\d{{13,19}}|[a-z]{{2}}\d{{2}}(?:{O}[a-z0-9]{{4}}){{3,7}})(?![\w-]|\.\d)"
)
# What stands to the left and to the right of an address word.
NUMBERED_NAME = re.compile(rf"(?:\b(?:apt|flat|unit|suite)\.?{S}\d{{1,4}}{W}?,?{S})?(?<![\w.+-])\d{{1,5}}{W}?,?{S}(?:{W}{{1,40}}{S}){{1,2}}\Z")
NUMBER_LEFT = re.compile(rf"(?<![\w.+-])\d{{1,5}},?{S}\Z")
NAME_RIGHT = re.compile(rf"{S}(?:(?:du|de la|de l['’]|des|de|d['’]){O})?{W}+")
JOINED_LEFT = re.compile(rf"\b{W}{{1,40}}\Z")
NUMBER_RIGHT = re.compile(rf"{S}\d{{1,4}}{W}?\b")
NAME_NUMBER_RIGHT = re.compile(rf"{S}(?:(?:de|del|la|las|los|do|da){S}){{0,2}}{W}+,?{S}\d{{1,5}}\b")
PO_LEFT, BOX_RIGHT = re.compile(rf"\bp\.?{O}o\.?{O}\Z"), re.compile(rf"{S}\d{{1,6}}\b")
TOWN = re.compile(r",\s{1,3}[A-ZÀ-ÞА-Я][\w'’-]+(?:\s{1,3}[A-ZÀ-ÞА-Я][\w'’-]+)?")
# What stands to the left and to the right of a name's anchor.
NAME_WORD = rf"(?!(?:{'|'.join(sorted(NOT_NAMES | {'plays', 'play', 'said', 'says', 'by', 'please', 'lol', 'chat', 'too'}))})\b){W}[\w'’-]{{1,40}}"
INITIAL = rf"(?:{W}\.?{S})?"
TITLE = rf"(?:{'|'.join(TITLES)})\b\.?{S}(?:{NAME_WORD}{S}{INITIAL})?{NAME_WORD}"
NAME_BODY = rf"(?:{TITLE}|{NAME_WORD}{S}{INITIAL}{NAME_WORD}|{NAME_WORD},{S}{NAME_WORD})"
TITLED = re.compile(TITLE)
LED = re.compile(rf"(?::|,)?{S}({NAME_BODY})")
CALLED = re.compile(rf"(?:{S}{W}+){{0,3}}{S}(?:is|was){S}({NAME_BODY})")
TAILED = re.compile(rf"(?<!\w)({NAME_BODY}){S}\Z")
PAIRED = re.compile(rf"(?<!\w)({NAME_BODY}){S}(?:then|and)(?:{S}{W}+){{0,3}}{S}\Z")
#: Characters to either side of an anchor that a parser may look at.
REACH = 120

AT, AT_WORD, PAIR, STREET, NUMBER_NAME, ENDING, NAME_NUMBER, BOX, LEAD, TITLE_WORD, PERSON, TAIL = (1 << i for i in range(12))


def _automaton() -> ahocorasick.Automaton:
    """Anchor -> (its length, what it is an anchor of)."""
    a = ahocorasick.Automaton()
    roles: dict[str, int] = {}
    for words, role in (
        (AT_SIGNS, AT), ((" at",), AT_WORD), ([f"{i:02d}" for i in range(100)], PAIR), ([f" {w}" for w in STREET_WORDS], STREET), ([f" {w} " for w in BEFORE_NAMES], NUMBER_NAME),
        ([f"{w} " for w in ENDINGS], ENDING), ([f"{w} " for w in BEFORE_NUMBERS], NAME_NUMBER), (("box ",), BOX), (LEADS, LEAD), ([f"{t}{e}" for t in TITLES for e in (" ", ". ")], TITLE_WORD), ([f"{p} " for p in PERSONS], PERSON), (TAILS, TAIL),
    ):
        for w in words:
            roles[w] = roles.get(w, 0) | role
    for w, role in roles.items():
        a.add_word(w, (len(w), role))
    a.make_automaton()
    return a


_AC: list[ahocorasick.Automaton] = []
_PLAIN = {ord(c): " " for c in SPACES + "\n"}


def level(text: str) -> str:
    """Lower case, full-width forms made plain and white space plain blanks, character by character, so that positions stay."""
    if text.isascii():
        low = text.lower()
        return low.translate(_PLAIN) if "\t" in low or "\n" in low else low
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in (x.lower() if len(x.lower()) == 1 else x for x in text)).translate(_PLAIN)


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _id_ok(m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    if len(digits) >= 12 and not re.search(r"[a-z]", m):
        return len(digits) <= 19 and _luhn(digits)
    if len(digits) >= 12:
        code = re.sub(r"\W", "", m)
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    return True


def _name_ok(m: str, low_cased: bool) -> bool:
    words = [w for w in re.findall(r"[^\W\d_][\w'’-]*", m)]
    low = [w.lower() for w in words]
    if low[0] in TITLES:
        return len(low) > 1 and (low_cased or all(w[0].isupper() for w in words)) and (low[0] != "miss" or not low_cased)
    if low[0] in CHARACTERS or any(w in NOT_NAMES for w in low if len(w) > 1) or any(re.search(r"\d|_", w) for w in words):
        return False
    return low_cased or all(w[0].isupper() for w in words)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Message:
    """One message and what the parsers found in it from the anchors given."""

    def __init__(self, text: str, low: str, hits: list[tuple[int, int, int]]):
        self.text, self.low = text, low
        self.cases: list[tuple[int, int, int]] = []
        self.numbers_until = -1
        names = []
        for a, b, role in hits:
            if role & PAIR:
                if a >= self.numbers_until:
                    self._number(a)
            elif role & (AT | AT_WORD):
                self._email(a, b, role)
            elif role & (LEAD | TITLE_WORD | PERSON | TAIL):
                names.append((a, b, role))
            else:
                self._address(a, b, role)
        for a, b, role in names:
            self._name(a, b, role)
        for start, _, _ in sorted(self.cases):
            m = PAIRED.search(low, max(0, start - REACH), start)
            if m:
                self._named(m)

    def _email(self, a: int, b: int, role: int) -> None:
        low = self.low
        left, right = a, b
        if role & AT_WORD:
            m = DOMAIN_WORDS.match(low, b, b + 4 * REACH)
        else:
            if low[a] != "@":
                while left and a - left < 3 and low[left - 1] == " ":
                    left -= 1
                while right < len(low) and right - b < 3 and low[right] == " ":
                    right += 1
            m = DOMAIN.match(low, right, right + 4 * REACH)
        if m:
            while role & AT_WORD and left and a - left < 2 and low[left - 1] == " ":
                left -= 1
            local = LOCAL.search(low, max(0, left - 66), left)
            if local:
                self.cases.append((local.start(), m.end(), EMAIL))

    def _number(self, at: int) -> None:
        """From a pair of digits to the ends of the stretch of digits and separators around it, with the letters that a number may begin or end with."""
        low = self.low
        a, b = at, at
        digits = 0
        while a and low[a - 1] in NUMERIC:
            a -= 1
        while b < len(low) and (low[b] in NUMERIC or (low[b].isalnum() and low[b].isascii())):
            digits += low[b] in "0123456789"
            b += 1
        self.numbers_until = b
        if digits < 6:
            return
        for _ in range(4):
            if a and low[a - 1].isalnum():
                a -= 1
        ids = [m.span() for m in IDS.finditer(low, a, min(len(low), b + 2)) if _id_ok(m[0])]
        self.cases += [(*t, ID) for t in ids]
        for m in PHONES.finditer(low, a, min(len(low), b + 2)):
            n = sum(map(str.isdigit, m[0]))
            if 8 <= n <= 15 and not any(x < m.end() and m.start() < y for x, y in ids) and not (n == len(m[0]) and NO_PHONE.search(low, max(0, m.start() - REACH), m.end() + REACH)):
                self.cases.append((*m.span(), PHONE))

    def _address(self, a: int, b: int, role: int) -> None:
        low = self.low
        after = low[b] if b < len(low) else " "
        near = max(0, a - REACH)
        if role & STREET and not _word(after):
            m = NUMBERED_NAME.search(low, near, a + 1)
            if m:
                self._place(m.start(), b + (after == "."))
        if role & NUMBER_NAME:
            m, r = NUMBER_LEFT.search(low, near, a + 1), NAME_RIGHT.match(low, b - 1)
            if m and r:
                self._place(m.start(), r.end())
        if role & ENDING:
            m, r = JOINED_LEFT.search(low, near, b - 1), NUMBER_RIGHT.match(low, b - 1)
            if m and r and m.end() - m.start() > b - 1 - a:
                self._place(m.start(), r.end())
        if role & NAME_NUMBER and not (a and _word(low[a - 1])):
            r = NAME_NUMBER_RIGHT.match(low, b - 1)
            if r:
                self._place(a, r.end())
        if role & BOX:
            m, r = PO_LEFT.search(low, near, a), BOX_RIGHT.match(low, b - 1)
            if m and r:
                self._place(m.start(), r.end())

    def _place(self, a: int, b: int) -> None:
        if NOT_STREETS.isdisjoint(WORDS.findall(self.low, a, b)):
            town = TOWN.match(self.text, b)
            self.cases.append((a, town.end() if town else b, ADDRESS))

    def _name(self, a: int, b: int, role: int) -> None:
        low = self.low
        if role & TAIL:
            m = TAILED.search(low, max(0, a - REACH), a)
            if m:
                self._named(m)
        if a and _word(low[a - 1]):
            return
        if role & TITLE_WORD and (m := TITLED.match(low, a)):
            self._named(m, 0)
        if role & LEAD and (m := LED.match(low, b)):
            self._named(m)
        if role & PERSON and not self.flat and (m := CALLED.match(low, b - 1)):
            self._named(m)

    def _named(self, m: re.Match, group: int = 1) -> None:
        if _name_ok(self.text[m.start(group) : m.end(group)], self.flat):
            self.cases.append((*m.span(group), NAME))

    @cached_property
    def flat(self) -> bool:
        """Is the message all in one case, or all capitalised, so that a capital tells nothing?"""
        letters = [c for c in self.text if c.isalpha()]
        firsts = [w[0] for w in self.text.split() if w[0].isalpha()]
        return self.text == self.text.lower() or sum(map(str.isupper, letters)) > 0.6 * len(letters) or sum(map(str.isupper, firsts)) >= 0.9 * max(1, len(firsts))

    def kept(self) -> list[tuple[int, int, int]]:
        """The cases from left to right, the longest where they overlap."""
        out: list[tuple[int, int, int]] = []
        for t in sorted(set(self.cases), key=lambda t: (t[0], -t[1], t[2])):
            if not out or t[0] >= out[-1][1]:
                out.append(t)
        return out


def found(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every case in one message."""
    return next((cases for _, cases in found_in([text])), [])


def found_in(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(message number, its cases) of the messages that have some, by one automaton pass over all of them."""
    if not _AC:
        _AC.append(_automaton())
    lows = [level(t) for t in texts]
    hits: dict[int, list[tuple[int, int, int]]] = {}
    i = start = 0
    stop = len(lows[0]) if lows else 0
    for end, (size, role) in _AC[0].iter("\n".join(lows)):
        while end > stop:
            i += 1
            start = stop + 1
            stop = start + len(lows[i])
        if end - size + 1 >= start and end < stop:
            hits.setdefault(i, []).append((end - size + 1 - start, end + 1 - start, role))
    for i, own in hits.items():
        cases = Message(texts[i], lows[i], own).kept()
        if cases:
            yield i, cases


def _found(key: int, messages: list[str]) -> Iterator[tuple]:
    for i, cases in found_in([parse_line(m)[2] for m in messages]):
        for k in sorted({k for _, _, k in cases}):
            yield key, i + 1, KINDS[k]


def redact(raw: str) -> str:
    """The line with every case in its text replaced by its typed placeholder, the rest kept."""
    text = parse_line(raw)[2] if raw and not raw.isspace() else ""
    return replaced(raw, text, found(text))


def replaced(raw: str, text: str, cases: list[tuple[int, int, int]]) -> str:
    at = raw.find(text) if text else -1
    if at < 0 and cases:  # escapes in a JSON line: its source is searched instead
        at, text, cases = 0, raw, found(raw)
    if not cases:
        return raw
    out, last = [raw[:at]], 0
    for a, b, k in cases:
        out += [text[last:a], PLACEHOLDERS[k]]
        last = b
    return "".join([*out, text[last:], raw[at + len(text) :]])


def _redacted(key: int, messages: list[str]) -> Iterator[tuple]:
    texts = [parse_line(m)[2] for m in messages]
    out = list(messages)
    n = 0
    for i, cases in found_in(texts):
        out[i] = replaced(messages[i], texts[i], cases)
        n += 1
    yield key, out, n


def personal_info(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, line_no, kind). Narrow: no shuffle."""
    return over_records(tables, _found, "rec_id long, line_no long, kind string", [("rec_id", pa.int64()), ("line_no", pa.int64()), ("kind", pa.string())])


def redacted(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, rec_id, messages): the non-blank messages of each record with typed placeholders."""
    return over_records(tables, _redacted, "rec_id long, messages array<string>, n_changed int", [("rec_id", pa.int64()), ("messages", pa.list_(pa.string())), ("n_changed", pa.int32())]).drop("n_changed")
