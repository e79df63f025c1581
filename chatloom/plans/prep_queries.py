"""Prep profile: queries and their SQL."""

from __future__ import annotations

from chatloom import lexicon as L
from chatloom.operators import prep
from chatloom.plans import sqlparts as S
from chatloom.session import table


def _rows(s, d):
    return table(s, d, "prep_input")


QUERIES = {
    "prep_clean_lines": lambda s, d: prep.clean_lines(_rows(s, d)),
    "prep_topic_grams": lambda s, d: prep.grams(_rows(s, d)).where("occurrences >= 3").select("row_no", "gram", "occurrences"),
    "prep_topic": lambda s, d: prep.topics(_rows(s, d)),
    "prep_sentiment": lambda s, d: prep.sentiments(_rows(s, d)),
    "prep_quotes": lambda s, d: prep.quotes(_rows(s, d)),
    "prep_summaries": lambda s, d: prep.summaries(_rows(s, d)),
    "prep_totals": lambda s, d: prep.totals(_rows(s, d)),
    "prep_label_histogram": lambda s, d: prep.label_histogram(prep.summaries(_rows(s, d)), "target_text"),
}

_stamp = rf"^\[[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}\]{L.WS}*"
_a = S.strip(S.sub(S.strip("raw"), _stamp))
_b = f"CASE WHEN contains(a, ':') AND length(split_part(a, ':', 1)) <= 160 AND {S.has('lower(split_part(a, chr(58), 1))', L.PREP_METADATA)} THEN {S.strip('substr(a, instr(a, chr(58)) + 1)')} ELSE a END"
_c = S.strip(S.sub("b", rf"^[^:]{{1,40}}:{L.WS}*"))
_chars = "string_split(c, '')"
_d = "CASE WHEN c = '' THEN '' ELSE array_to_string(list_filter(cs, lambda x, i: NOT (i > 3 AND cs[i - 1] = x AND cs[i - 2] = x AND cs[i - 3] = x)), '') END"
_e = "array_to_string(list_filter(ts, lambda x, i: NOT (i > 2 AND lower(ts[i - 1]) = lower(x) AND lower(ts[i - 2]) = lower(x))), ' ')"
_lines = f"""SELECT row_no, pos, {S.squeeze(_e)} AS line FROM (
  SELECT row_no, pos, {S.tokens('d')} AS ts FROM (SELECT row_no, pos, {_d} AS d FROM (SELECT row_no, pos, c, {_chars} AS cs FROM (SELECT row_no, pos, {_c} AS c FROM (SELECT row_no, pos, {_b} AS b FROM (SELECT row_no, pos, {_a} AS a FROM (
    SELECT row_no, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw FROM (SELECT row_no, regexp_split_to_array(coalesce(input_text, ''), {S.q(L.LINE_BREAK)}) AS l FROM (SELECT DISTINCT row_no, input_text FROM prep_input)))))))))"""
_noise = f"{S.has('lower(line)', L.PREP_BOTS)} OR {S.has('lower(line)', L.PREP_NOISE_LINE)} OR (len({S.tokens('line')}) >= 5 AND len(list_distinct({S.tokens('lower(line)')})) = 1) OR NOT {S.has('line', '[[:alpha:]]|' + chr(92) + 'pL')}"
LINES = f"SELECT row_no, pos, line FROM (SELECT row_no, min(pos) AS pos, min_by(line, pos) AS line FROM ({_lines}) WHERE line <> '' AND NOT ({_noise}) GROUP BY row_no, lower(line)) QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY pos) <= 140"
_noise_token = lambda t: f"({t} IN ({S.listed([*L.PREP_STOPWORDS, *L.PREP_NOISE_EXACT])}) OR length({t}) > 12 OR {S.has(t, '^(?:' + '|'.join(L.PREP_NOISE_PREFIXES) + ')')})"
_toks = f"SELECT row_no, pos, list_filter({S.words('line', '[a-z]{3,}')}, lambda t: NOT {_noise_token('t')}) AS t FROM ({LINES})"
_grams = f"""SELECT row_no, gram, pair, count(*) AS occurrences, min((pos, i)) AS place FROM (SELECT row_no, gram, pair, pos, min(i) AS i FROM (
    SELECT row_no, pos, unnest(t) AS gram, false AS pair, generate_subscripts(t, 1) AS i FROM ({_toks})
    UNION ALL SELECT row_no, pos, t[i] || ' ' || t[i + 1], true, i FROM (SELECT row_no, pos, t, unnest(range(1, len(t))) AS i FROM ({_toks}))) GROUP BY ALL) GROUP BY row_no, gram, pair"""
_enough = f"SELECT row_no FROM ({LINES}) GROUP BY row_no HAVING count(*) >= 4"
_topic = f"""SELECT row_no, coalesce(two, one, {S.q(L.NO_TOPIC)}) AS topic FROM ({_enough}) LEFT JOIN (
    SELECT row_no, min_by(gram, (-occurrences, -length(gram), place)) FILTER (pair) AS two, min_by(gram, (-occurrences, length(gram), place)) FILTER (NOT pair) AS one FROM ({_grams}) WHERE occurrences >= 3 GROUP BY row_no) USING (row_no)"""
_n = lambda k: f"len(list_filter({S.words('line', chr(91) + 'a-z' + chr(39) + chr(93) + '+')}, lambda t: t IN ({S.listed(L.PREP_SENTIMENT[k])})))"
_sent = f"""SELECT row_no, laughter, confusion, positive, negative, CASE WHEN laughter >= 2 AND laughter >= greatest(confusion, positive, negative) THEN 'laughter' WHEN confusion >= 2 AND confusion >= greatest(laughter, positive, negative) THEN 'confusion'
    WHEN positive - negative >= 2 THEN 'approval' WHEN negative - positive >= 2 THEN 'disapproval' ELSE 'mixed' END AS sentiment
  FROM (SELECT row_no, {', '.join(f'sum({_n(k)})::BIGINT AS {k}' for k in L.PREP_SENTIMENT)} FROM ({LINES}) GROUP BY row_no HAVING count(*) >= 4)"""
_bare = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
_lettered = f"list_filter({S.tokens('line')}, lambda w: regexp_matches(w, '[A-Za-z]'))"
_readable = f"len({S.tokens('line')}) >= 4 AND len(lt) >= 4 AND 2 * len(list_filter(lt, lambda w: {_bare} <> '' AND {_noise_token(_bare)})) <= len(lt)"
_charged = "|".join(sorted({w for ws in L.PREP_SENTIMENT.values() for w in ws}))
_score = f"CASE WHEN topic <> {S.q(L.NO_TOPIC)} THEN CASE WHEN contains(lower(line), topic) THEN 2 ELSE 0 END + len(list_filter(string_split(topic, ' '), lambda w: contains(lower(line), w))) ELSE 0 END + CASE WHEN {S.has('lower(line)', _charged)} THEN 1 ELSE 0 END + CASE WHEN readable THEN 2 ELSE 0 END"
_short = f"CASE WHEN len({S.tokens('line')}) <= 12 THEN line ELSE array_to_string(({S.tokens('line')})[1:12], ' ') END"
_quotes_sql = f"""SELECT row_no, max(s) FILTER (r = 1) AS quote_1, coalesce(max(s) FILTER (r = 2), max(s) FILTER (r = 1)) AS quote_2 FROM (
    SELECT row_no, {_short} AS s, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, pos) AS r FROM (
      SELECT *, {_score} AS score, count(*) FILTER (readable) OVER (PARTITION BY row_no) AS nr FROM (SELECT *, {_readable} AS readable FROM (SELECT *, {_lettered} AS lt FROM ({LINES}) JOIN ({_topic}) USING (row_no)))) WHERE readable OR nr < 2) WHERE r <= 2 GROUP BY row_no"""
_digits = "list_transform(string_split(md5(id), ''), lambda c: instr('0123456789abcdef', c) - 1)"
_mod = f"((4 * (list_sum({_digits}) - ({_digits})[32]) + ({_digits})[32]) % 6)::INT"
_lead = "[" + S.listed(L.LEADS) + f"][{_mod} + 1]"
_reason = "CASE sentiment " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in L.REASONS.items()) + " END"
_sum = f"""SELECT row_no, id, input_text, replace(replace({_lead}, '{{topic}}', topic), '{{sentiment}}', sentiment) || ' Lines such as ''' || quote_1 || ''' and ''' || quote_2 || ''' ' || {_reason} || '.' AS target_text
  FROM (SELECT DISTINCT row_no, coalesce(id, 'row_' || row_no) AS id FROM prep_input) JOIN ({_topic}) USING (row_no) JOIN ({_sent}) USING (row_no) JOIN ({_quotes_sql}) USING (row_no)
  JOIN (SELECT row_no, string_agg(line, chr(10) ORDER BY pos) AS input_text FROM ({LINES}) GROUP BY row_no) USING (row_no)"""
ORACLES = {
    "prep_clean_lines": LINES,
    "prep_topic_grams": f"SELECT row_no, gram, occurrences FROM ({_grams}) WHERE occurrences >= 3",
    "prep_topic": _topic,
    "prep_sentiment": _sent,
    "prep_quotes": _quotes_sql,
    "prep_summaries": _sum,
    "prep_totals": f"SELECT rows_in, rows_out, rows_in - rows_out AS rows_dropped, fallback_topics FROM (SELECT count(*) AS rows_in FROM (SELECT DISTINCT row_no, input_text FROM prep_input) WHERE {S.strip('input_text')} <> ''), (SELECT count(*) AS rows_out, count(*) FILTER (topic = {S.q(L.NO_TOPIC)}) AS fallback_topics FROM ({_topic}))",
    "prep_label_histogram": f"SELECT CASE WHEN l = '' THEN 'none' ELSE l END AS label, count(*) AS n FROM (SELECT regexp_extract(lower(target_text), '\\b({'|'.join(L.SENTIMENTS)})\\b', 1) AS l FROM ({_sum})) GROUP BY 1",
}
