"""Fragments of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations

from chatloom import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(xs) -> str:
    return ", ".join(q(x) for x in xs)


def sub(x: str, p: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(p)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{L.WS}+|{L.WS}+$")


def squeeze(x: str) -> str:
    return strip(sub(x, f"{L.WS}+", " "))


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def part(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, {q(p)}, {g})"


def found(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, {q(p)})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(L.WS + '+')}), lambda w: w <> '')"


def words(x: str, p: str = "[a-z0-9']+") -> str:
    return found(f"lower({x})", p)


def split_lines(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(L.LINE_BREAK)}), lambda w: {strip('w')} <> '')"


def normalized(x: str, any_case: bool = True) -> str:
    return squeeze(sub(sub(x, L.URL if any_case else L.URL_CASED, " "), L.MENTION, " "))


def badge_free(x: str) -> str:
    return squeeze(sub(x, L.BADGE, " "))


def user_of(s: str) -> str:
    b, p = L.BRACKET_LINE, L.PLAIN_LINE
    return f"CASE WHEN {has(s, b)} THEN {strip(sub(part(s, b, 1), L.BADGE))} WHEN {has(s, p)} THEN {strip(sub(part(s, p, 1), L.BADGE))} ELSE '' END"


def text_of(s: str) -> str:
    b, p = L.BRACKET_LINE, L.PLAIN_LINE
    return f"CASE WHEN {has(s, b)} THEN {strip(part(s, b, 2))} WHEN {has(s, p)} THEN {strip(part(s, p, 2))} ELSE {s} END"


def delivered() -> str:
    return f"SELECT window_id, line_no, min(raw) AS raw FROM chat_log GROUP BY window_id, line_no HAVING {strip('min(raw)')} <> ''"


def parsed(lines: str) -> str:
    return f"SELECT window_id, line_no, raw, {user_of('s')} AS usr, {text_of('s')} AS txt FROM (SELECT *, {strip('raw')} AS s FROM ({lines}))"


def cleaned(lines: str, flood: bool = True) -> str:
    """window_id, line_no, status, runs, payload, key of every line, default options."""
    system = f"txt = '' OR lower(usr) IN ({listed(L.DISTILL_BOTS)}) OR {has('lower(txt)', L.DISTILL_SYSTEM)}"
    base = f"""SELECT window_id, line_no, raw, payload,
        CASE WHEN {system} THEN 'system' WHEN length(payload) < 2 THEN CASE WHEN {has('raw', L.BADGE)} THEN 'noise' ELSE 'empty' END ELSE 'kept' END AS status,
        {tokens('payload')} AS toks
      FROM (SELECT *, {normalized(badge_free('txt'))} AS payload FROM ({parsed(lines)}))"""
    runs = f"SELECT *, list_filter(range(1, len(toks) + 1), lambda i: i = 1 OR lower(toks[i]) <> lower(toks[i - 1])) AS starts FROM ({base})"
    sized = f"SELECT *, list_transform(starts, lambda x, k: coalesce(starts[k + 1], len(toks) + 1) - x) AS lens, list_transform(toks, lambda x: lower(x)) AS low FROM ({runs})"
    kinds = f"SELECT *, list_filter(low, lambda x, k: list_position(low, x) = k) AS kinds, len(list_filter(lens, lambda m: m >= 4)) AS big FROM ({sized})"
    cnt = lambda w: f"len(list_filter(low, lambda x: x = {w}))"
    show = lambda w: f"CASE WHEN {cnt(w)} >= 4 THEN {w} || ' x' || {cnt(w)} ELSE array_to_string(list_filter(low, lambda x: x = {w}), ' ') END"
    folded = "array_to_string(list_transform(starts, lambda x, k: CASE WHEN lens[k] >= 4 THEN toks[x] || ' x' || lens[k] ELSE array_to_string(toks[x:x + lens[k] - 1], ' ') END), ' ')"
    two = f"CASE WHEN len(kinds) = 1 THEN {show('kinds[1]')} WHEN {cnt('kinds[2]')} > {cnt('kinds[1]')} THEN {show('kinds[2]')} || ' ' || {show('kinds[1]')} ELSE {show('kinds[1]')} || ' ' || {show('kinds[2]')} END"
    flooded = f"""SELECT window_id, line_no, status,
        CASE WHEN status <> 'kept' OR len(toks) < 4 THEN 0 WHEN big > 0 THEN big WHEN len(kinds) <= 2 THEN 1 ELSE 0 END AS runs,
        CASE WHEN status <> 'kept' OR len(toks) < 4 THEN payload WHEN big > 0 THEN {folded} WHEN len(kinds) <= 2 THEN {two} ELSE payload END AS payload
      FROM ({kinds})"""
    keyed = f"SELECT *, array_to_string({words('payload')}, ' ') AS key FROM ({flooded})"
    return f"SELECT window_id, line_no, runs, payload, key, CASE WHEN status = 'kept' AND key = '' THEN 'empty' ELSE status END AS status FROM ({keyed})"


def key_counts(lines: str) -> str:
    return f"SELECT window_id, key, count(*) AS n, min(line_no) AS first_line, min_by(payload, line_no) AS line FROM ({cleaned(lines)}) WHERE status = 'kept' GROUP BY window_id, key"


def distilled(lines: str) -> str:
    return f"""SELECT window_id, first_line, copy, line FROM (
        SELECT window_id, first_line, unnest(range(1, CASE WHEN n >= 3 THEN 2 ELSE n + 1 END)) AS copy, CASE WHEN n >= 3 THEN line || ' x' || n ELSE line END AS line FROM ({key_counts(lines)}))"""


def pair_lines() -> str:
    return f"SELECT pair_id AS window_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS raw FROM (SELECT pair_id, {split_lines('chat')} AS l FROM summary_pairs)"


def md5_order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"
