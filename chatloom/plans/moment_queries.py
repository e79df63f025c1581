"""Moments: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.operators import moments
from chatloom.plans import sqlparts as S
from chatloom.session import table


def _raw(s, d):
    return table(s, d, "moment_data")


def _profile(s, d):
    return moments.profile(_raw(s, d))


QUERIES = {
    "moment_messages": lambda s, d: moments.messages(_raw(s, d)).select("moment_id", F.array_join("messages", "\n").alias("said"), F.array_join("keys", "\n").alias("key_lines")),
    "moment_tone_scores": lambda s, d: _profile(s, d).select("moment_id", *moments.TONE_ORDER),
    "moment_tone": lambda s, d: moments.tones(_profile(s, d)),
    "moment_concepts": lambda s, d: _profile(s, d).select("moment_id", F.explode("counts").alias("concept", "n")),
    "moment_person": lambda s, d: _profile(s, d).where("person IS NOT NULL").select("moment_id", "person"),
    "moment_ngrams": lambda s, d: moments.phrases(_raw(s, d)).where("n >= 2"),
    "moment_phrase": lambda s, d: _profile(s, d).where("phrase IS NOT NULL").select("moment_id", "phrase", "n"),
    "moment_topic": lambda s, d: moments.topics(_profile(s, d)).select("moment_id", "topic", "kind"),
    "moment_summary": lambda s, d: moments.summaries(_raw(s, d)),
    "moment_preview": lambda s, d: moments.summaries(_raw(s, d)).select("moment_id", moments.preview(F.col("summary"), 60).alias("shown")),
    "rewritten_moments": lambda s, d: moments.rewritten(_raw(s, d)).select("moment_id", "window_id", F.col("abstractive_summary.summary").alias("summary")),
}

_sys = lambda u, t: f"({'' if u is None else f'lower({u}) IN ({S.listed(L.DISTILL_BOTS)}) OR '}{' OR '.join(f'contains(lower({t}), {S.q(p)})' for p in L.MOMENT_SYSTEM)})"
_user = lambda r: f"CASE WHEN {S.has(r, L.BRACKET_LINE)} THEN {S.strip(S.part(r, L.BRACKET_LINE, 1))} ELSE '' END"
_text = lambda r: f"CASE WHEN {S.has(r, L.BRACKET_LINE)} THEN {S.strip(S.part(r, L.BRACKET_LINE, 2))} ELSE {S.strip(r)} END"
_said = f"list_transform(list_filter(list_filter(coalesce(messages, []), lambda x: x IS NOT NULL), lambda x: ({_text('x')}) <> '' AND NOT {_sys(f'({_user(chr(120))})', f'({_text(chr(120))})')}), lambda x: {S.normalized(f'({_text(chr(120))})', False)})"
_keys = f"list_filter(list_transform(list_filter(coalesce(extractive_summary.key_messages, []), lambda x: x IS NOT NULL), lambda x: {S.normalized(f'({_text(chr(120))})', False)}), lambda x: x <> '' AND NOT {_sys(None, 'x')})"
M = f"SELECT *, list_concat(said, keys) AS combined FROM (SELECT moment_id, lower(file_name) AS file, {_said} AS said, {_keys} AS keys FROM moment_data)"
_hits = lambda p: f"coalesce(list_sum(list_transform(combined, lambda x: len({S.found('lower(x)', p)}))), 0)"
_scores = f"""SELECT moment_id, round(laughter + {L.MOCKERY_WEIGHT}::DOUBLE * mockery, 6) AS laughter, hype::DOUBLE AS hype, approval::DOUBLE AS approval, round(confusion + {L.QUESTION_WEIGHT}::DOUBLE * questions, 6) AS confusion, frustration::DOUBLE AS frustration
  FROM (SELECT moment_id, {', '.join(f'{_hits(p)} AS {k}' for k, p in L.TONES.items())}, {_hits('[?]')} AS questions FROM ({M}))"""
_tone = f"""SELECT moment_id, CASE WHEN a < 2.2 THEN 'chaotic' WHEN b >= 2.4 AND b >= a * 0.78::DOUBLE THEN 'mixed' ELSE ka END AS tone,
    CASE WHEN a < 2.2 THEN NULL WHEN b >= 2.4 AND b >= a * 0.78::DOUBLE THEN ka || ',' || kb WHEN b >= 2.8 AND b >= a * 0.6::DOUBLE THEN kb END AS secondary
  FROM (SELECT moment_id, max(v) FILTER (r = 1) AS a, max(v) FILTER (r = 2) AS b, max(k) FILTER (r = 1) AS ka, max(k) FILTER (r = 2) AS kb FROM (
    SELECT moment_id, k, v, row_number() OVER (PARTITION BY moment_id ORDER BY v DESC, i) AS r FROM ({' UNION ALL '.join(f"SELECT moment_id, '{k}' AS k, {k} AS v, {i} AS i FROM ({_scores})" for i, k in enumerate(moments.TONE_ORDER))})) GROUP BY moment_id)"""
_subs = lambda ws: " + ".join(f"(length(low) - length(replace(low, {S.q(w)}, ''))) // {len(w)}" for w in ws)
_joined = f"SELECT moment_id, array_to_string(combined, chr(10)) AS t, lower(array_to_string(combined, chr(10))) AS low FROM ({M})"
_names = f"list_filter(list_transform(regexp_extract_all(t, {S.q('(?i)' + L.CALL_PATTERN)}, 1), lambda x: lower(x)), lambda x: x NOT IN ({S.listed(L.GENERIC_CALL_NAMES)}) AND length(x) >= 4)"
_counts = [f"SELECT moment_id, {S.q(k)} AS concept, len({S.found('t', '(?i)' + p)}) AS n FROM ({_joined})" for k, p in L.CONCEPTS.items()]
_counts += [
    f"SELECT moment_id, 'death' AS concept, len(list_filter({S.words('t', chr(91) + 'a-z][a-z0-9' + chr(39) + ']+')}, lambda w: w IN ({S.listed(L.DEATH_WORDS)}))) AS n FROM ({_joined})",
    *(f"SELECT moment_id, '{k}' AS concept, {_subs(ws)} AS n FROM ({_joined})" for k, ws in (("teamplay", L.TEAMPLAY_WORDS), ("looks", L.LOOK_WORDS), ("argument", L.ARGUMENT_WORDS))),
]
_person = f"SELECT moment_id, w AS name, n FROM (SELECT moment_id, w, count(*) AS n FROM (SELECT moment_id, unnest({S.words('t', chr(91) + 'a-z][a-z0-9' + chr(39) + ']+')}) AS w FROM ({_joined})) WHERE length(w) >= 4 AND w NOT IN ({S.listed([*L.MOMENT_STOPWORDS, *L.MOMENT_NOISE, *L.NO_PERSONS])}) GROUP BY moment_id, w HAVING count(*) >= {L.PERSON_LEAST}) QUALIFY row_number() OVER (PARTITION BY moment_id ORDER BY n DESC, w DESC) = 1"
_calls = f"SELECT moment_id, min_by(name, (-n, place)) AS name, max(n) + 1 AS n FROM (SELECT moment_id, name, count(*) AS n, min(place) AS place FROM (SELECT moment_id, unnest(ns) AS name, generate_subscripts(ns, 1) AS place FROM (SELECT moment_id, {_names} AS ns FROM ({_joined}))) GROUP BY moment_id, name) GROUP BY moment_id"
CONCEPTS = f"SELECT moment_id, concept, n FROM ({' UNION ALL '.join(_counts)}) WHERE n > 0 UNION ALL SELECT moment_id, 'call', n FROM ({_calls}) UNION ALL SELECT moment_id, 'person', n FROM ({_person})"
_weak = S.listed([*L.MOMENT_STOPWORDS, *L.MOMENT_NOISE])
_stop = S.listed(L.MOMENT_STOPWORDS)
_alias = "CASE file " + " ".join(f"WHEN {S.q(k)} THEN [{S.listed(v)}]" for k, v in L.ALIASES.items()) + " ELSE []::VARCHAR[] END"
_phr = f"""SELECT moment_id, phrase, count(*) AS n FROM (SELECT DISTINCT moment_id, p, array_to_string(g, ' ') AS phrase FROM (
    SELECT moment_id, al, p, t[i:i + k - 1] AS g FROM (SELECT moment_id, al, p, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM (
      SELECT moment_id, al, p, {S.words('x', chr(91) + 'a-z][a-z0-9' + chr(39) + ']+')} AS t, k FROM (SELECT moment_id, {_alias} AS al, generate_subscripts(combined, 1) AS p, unnest(combined) AS x FROM ({M})), (VALUES (1), (2), (3)) AS s(k))))
    WHERE CASE WHEN len(g) = 1 THEN g[1] NOT IN ({_weak}) AND (length(g[1]) >= 4 OR g[1] IN ({S.listed(L.SHORT_OK)}) OR list_contains(al, g[1])) ELSE len(list_distinct(g)) > 1 AND len(list_filter(g, lambda w: w NOT IN ({_weak}))) >= 2 AND g[1] NOT IN ({_stop}) AND g[-1] NOT IN ({_stop}) END) GROUP BY moment_id, phrase"""
_best = f"SELECT moment_id, max_by(phrase, (w, phrase)) AS phrase, max_by(n, (w, phrase)) AS n FROM (SELECT *, round(n * CASE WHEN len(string_split(phrase, ' ')) = 2 THEN 2.4::DOUBLE ELSE 3.0::DOUBLE END, 6) AS w FROM ({_phr}) WHERE n >= 2 AND contains(phrase, ' ')) GROUP BY moment_id"
_rule = lambda needs: " AND ".join(f"coalesce(cs[{S.q(k)}], 0) >= {n}" for k, n in needs)
_cased = f"array_to_string(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN length(w) > 3 THEN upper(w[1]) || w[2:] WHEN w IN ({S.listed(L.SHORT_OK)}) THEN upper(w) ELSE w END), ' ')"
_topic_sql = f"""SELECT moment_id, CASE {' '.join(f"WHEN {_rule(n)} THEN replace({S.q(t)}, '{{call}}', coalesce(upper(name[1]) || name[2:], ''))" for n, t, _ in L.TOPIC_RULES)}
      WHEN phrase IS NOT NULL AND NOT list_contains(al, phrase) THEN {_cased} WHEN len(list_filter(al, lambda a: contains(st, a))) > 0 THEN '{{streamer}}' END AS topic,
    CASE {' '.join(f"WHEN {_rule(n)} THEN '{k}'" for n, _, k in L.TOPIC_RULES)} WHEN phrase IS NOT NULL AND NOT list_contains(al, phrase) THEN 'phrase' WHEN len(list_filter(al, lambda a: contains(st, a))) > 0 THEN 'entity' END AS kind
  FROM (SELECT moment_id, {_alias} AS al, lower(array_to_string(said, ' ')) AS st FROM ({M})) LEFT JOIN (SELECT moment_id, map_from_entries(list((concept, n))) AS cs FROM ({CONCEPTS}) GROUP BY moment_id) USING (moment_id)
  LEFT JOIN (SELECT moment_id, name FROM ({_calls})) USING (moment_id) LEFT JOIN (SELECT moment_id, phrase FROM ({_best})) USING (moment_id)"""
_one = lambda m, k: f"CASE {k} " + " ".join(f"WHEN {S.q(x)} THEN {S.q(v)}" for x, v in m.items()) + " END"
_opts = lambda m, k, seed: f"CASE {k} " + " ".join(f"WHEN {S.q(x)} THEN ([{S.listed(v)}])[1 + {seed} % {len(v)}]" for x, v in m.items()) + " END"
_seed = lambda x: f"('0x' || substr(sha1({x}), 1, 8))::BIGINT"
_wc = lambda x: f"len(regexp_extract_all({x}, '\\{{streamer\\}}|[A-Za-z0-9'']+'))"
_told = f"""SELECT moment_id, seed, topic, kind, CASE WHEN dead THEN 'laughter' ELSE tone END AS tone, CASE WHEN dead THEN tone ELSE secondary END AS secondary FROM (
    SELECT *, coalesce(topic IN ({S.listed(moments.DEADPAN)}) AND tone IN ('frustration', 'confusion'), false) AS dead FROM ({_tone}) JOIN ({_topic_sql}) USING (moment_id)
    JOIN (SELECT moment_id, {_seed("coalesce(file_name, '') || ':' || coalesce(window_id, 'x')")} AS seed FROM moment_data) USING (moment_id))"""
_pair = f"coalesce({_one(moments.PAIRS, 'array_to_string(list_sort(string_split(secondary, chr(44))), chr(44))')}, replace(secondary, ',', ' mixed with '))"
_text = f"""coalesce({_opts(moments.TOPIC_TEXTS, 'topic', 'seed')}, {', '.join(f"CASE WHEN kind = {S.q(k)} THEN {_one(m, 'tone')} END" for k, m in moments.KIND_TEXTS.items())},
    CASE WHEN tone = 'mixed' THEN replace(CASE WHEN topic IS NOT NULL THEN {S.q(moments.MIXED_TEXTS[0])} ELSE {S.q(moments.MIXED_TEXTS[1])} END, '{{pair}}', {_pair}) END,
    CASE WHEN topic IS NOT NULL THEN {_one(moments.TONE_TEXTS, 'tone')} END, {_opts(moments.NO_TOPIC_TEXTS, 'tone', 'seed')})"""
_beside = f"CASE WHEN tone <> 'mixed' AND topic IS NOT NULL AND kind NOT IN ('bit', 'event', 'mood') THEN {_one(moments.SECOND, 'tone || chr(44) || secondary')} END"
_host = lambda x: S.sub(S.sub(x, f"(?i){L.HOST_NAMES}", "{streamer}"), r"\{streamer\}(?:\s+\{streamer\})+", "{streamer}")
_spoken = f"SELECT moment_id, tone, secondary, topic, kind, {_host(S.squeeze(f'upper(x[1]) || x[2:] || coalesce({_beside}, chr(32))'))} AS s FROM (SELECT *, replace({_text}, '{{topic}}', coalesce(topic, '')) AS x FROM ({_told}))"
_padded = f"""SELECT * EXCLUDE (s, p), CASE WHEN {_wc('p')} < 20 THEN p || coalesce({_opts(moments.PAD_TONE, "(CASE WHEN tone = 'mixed' THEN 'chaotic' ELSE tone END)", _seed('s'))}, '') ELSE p END AS s
    FROM (SELECT *, CASE WHEN {_wc('s')} < 20 THEN s || coalesce({_opts(moments.PAD_SECOND, "(CASE WHEN tone <> 'mixed' THEN secondary END)", _seed('s'))}, '') ELSE s END AS p FROM ({_spoken}))"""
SUMMARY = f"SELECT moment_id, tone, secondary, topic, kind, CASE WHEN {_wc('s')} > 55 AND contains(s, '. ') THEN split_part(s, '. ', 1) || '.' ELSE s END AS summary FROM ({_padded})"
ORACLES = {
    "moment_messages": f"SELECT moment_id, array_to_string(said, chr(10)) AS said, array_to_string(keys, chr(10)) AS key_lines FROM ({M})",
    "moment_tone_scores": _scores,
    "moment_tone": _tone,
    "moment_concepts": CONCEPTS,
    "moment_ngrams": f"SELECT * FROM ({_phr}) WHERE n >= 2",
    "moment_phrase": _best,
    "moment_person": f"SELECT moment_id, name AS person FROM ({_person})",
    "moment_topic": _topic_sql,
    "moment_summary": SUMMARY,
    "moment_preview": f"SELECT moment_id, CASE WHEN length(summary) > 60 THEN summary[1:60] || '...' ELSE summary END AS shown FROM ({SUMMARY})",
    "rewritten_moments": f"SELECT moment_id, window_id, summary FROM moment_data JOIN ({SUMMARY}) USING (moment_id)",
}
