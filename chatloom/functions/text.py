"""Text functions as column expressions: they stay in the JVM and fold into the plans that use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom import lexicon as L


#: A long run of digits is tried once.
BADGE = L.BADGE.replace("[0-9]+", "(?<![0-9])[0-9]++", 1)


def lit(x) -> Column:
    return F.lit(x)


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, f"^{L.WS}+|(?<!{L.WS}){L.WS}++$", "")  # inner runs are tried once, however long


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{L.WS}+", " "))


def nonblank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, lit("")))) > 0


def split_lines(c: Column) -> Column:
    """Non-blank lines; null gives none."""
    return F.filter(F.split(F.coalesce(c, lit("")), L.LINE_BREAK, -1), lambda x: F.length(strip(x)) > 0)


def tokens(c: Column) -> Column:
    """White-space tokens; none for blank text."""
    return F.filter(F.split(c, f"{L.WS}+", -1), lambda x: F.length(x) > 0)


def words(c: Column, pattern: str = "[a-z0-9']+") -> Column:
    """All matches of a word pattern in the lowered text."""
    return F.regexp_extract_all(F.lower(c), lit(f"({pattern})"), lit(1))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, lit("[A-Za-z0-9']+"))


def without_badge(c: Column) -> Column:
    return F.regexp_replace(c, BADGE, "")


def parsed(raw: Column) -> Column:
    """struct(user, text): bracket form, else ``user: text``, else the whole line as text."""
    s = strip(raw)
    user = lambda p: strip(without_badge(F.regexp_extract(s, p, 1)))
    text = lambda p: strip(F.regexp_extract(s, p, 2))
    bracket, plain = s.rlike(L.BRACKET_LINE), s.rlike(L.PLAIN_LINE)
    return F.struct(
        F.when(bracket, user(L.BRACKET_LINE)).when(plain, user(L.PLAIN_LINE)).otherwise("").alias("user"),
        F.when(bracket, text(L.BRACKET_LINE)).when(plain, text(L.PLAIN_LINE)).otherwise(s).alias("text"),
    )


def parsed_bracket(raw: Column) -> Column:
    """struct(user, text): bracket form only, else the whole line as text."""
    bracket = raw.rlike(L.BRACKET_LINE)
    return F.struct(
        F.when(bracket, strip(F.regexp_extract(raw, L.BRACKET_LINE, 1))).otherwise("").alias("user"),
        F.when(bracket, strip(F.regexp_extract(raw, L.BRACKET_LINE, 2))).otherwise(strip(raw)).alias("text"),
    )


def message_text(raw: Column) -> Column:
    """Text behind a non-empty bracket with white space after it, else the stripped line."""
    return F.when(raw.rlike(L.SPACED_BRACKET_LINE), strip(F.regexp_extract(raw, L.SPACED_BRACKET_LINE, 1))).otherwise(strip(raw))


def normalized(c: Column, any_case: bool = True) -> Column:
    """Links and mentions to blanks, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, L.URL if any_case else L.URL_CASED, " "), L.MENTION, " "))


def badge_free(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, BADGE, " "))


def dedup_key(c: Column) -> Column:
    return F.array_join(words(c), " ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: bound to a lambda's variable, it can't be inlined again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``df`` with only ``keep`` and the given columns, each computed once a row.

    A plain projection may be copied into every filter and projection above it, regex
    chains and all; the result of a generator can't be.
    """
    return df.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def sentences(c: Column) -> Column:
    """Sentences of a summary: label dropped, split behind . ! ?, closed with a full stop."""
    text = squeeze(F.regexp_replace(strip(c), rf"(?i)^summary:{L.WS}*", ""))
    parts = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){L.WS}+", -1), strip), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda x: F.when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, lit("."))))


def similar(a: Column, b: Column, jaccard: float = 0.86, containment: float = 0.92) -> Column:
    """Equal but for case, or enough words in common."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return (F.lower(a) == F.lower(b)) | (some & ((both >= jaccard * either) | (both >= containment * F.least(F.size(x), F.size(y)))))
