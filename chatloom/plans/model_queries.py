"""Retrieval, selection, packing and corpus building: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom import lexicon as L
from chatloom.functions import text as T
from chatloom.operators import corpus, distill, pack, retrieval, select
from chatloom.plans import sqlparts as S
from chatloom.session import stored, table
from chatloom.sources import io


def _docs(s, d):
    return retrieval.documents(table(s, d, "moment_data"))


def _stored_docs(s, d):
    return stored(_docs(s, d), "retrieval-documents")


def _vectors(s, d):
    docs = _stored_docs(s, d)
    known = docs.where("labelled")
    tf = stored(retrieval.term_counts(known), "retrieval-terms")
    weights = retrieval.idf(known, tf)
    return retrieval.vectors(tf, weights), weights, docs


def _nearest(s, d):
    v, weights, docs = _vectors(s, d)
    asked = docs.where("moment_id % 50 = 0")
    return retrieval.nearest(retrieval.vectors(retrieval.term_counts(asked), weights), v, 3, asked, docs.where("labelled"))


def _idf(s, d):
    known = _stored_docs(s, d).where("labelled")
    return retrieval.idf(known, retrieval.term_counts(known)).select("token", "df", F.round("idf", 6).alias("idf"))


def _pairs(s, d):
    return corpus.valid(table(s, d, "summary_pairs"))


def _raw_pairs(s, d):
    return table(s, d, "summary_pairs")


def _embeddings(s, d):
    return table(s, d, "embeddings")


def _distilled(s, d):
    return distill.texts(distill.pair_lines(_raw_pairs(s, d))).withColumnRenamed("window_id", "pair_id")


def _few(s, d):
    return pack.few_prompts(_raw_pairs(s, d), _raw_pairs(s, d).where("pair_id % 50 = 0"))


def _compared(s, d):
    """One nested document a pair: prompts, chunks and summary of the default model; times are left to the command line."""
    distilled = stored(_distilled(s, d), "compare-distilled")
    ran = pack.timed(distilled, "pair_id", "text", 64).drop("latency_ms")
    return distilled.join(ran, "pair_id").select("pair_id", io.as_json(F.size(T.split_lines(F.col("text"))).alias("lines"), F.struct("chunks", "summary").alias("model")).alias("result"))


QUERIES = {
    "tfidf_idf": _idf,
    "tfidf_vectors": lambda s, d: _vectors(s, d)[0].select("moment_id", "token", F.round("weight", 6).alias("weight")),
    "nearest_examples": lambda s, d: _nearest(s, d).select("moment_id", "example_id", F.round("score", 6).alias("score"), "rank"),
    "emotion_label": lambda s, d: retrieval.emotions(_docs(s, d)),
    "top_terms": lambda s, d: retrieval.top_terms(retrieval.term_counts(_docs(s, d))),
    "overlap_proxy": lambda s, d: retrieval.overlap(_docs(s, d).where("labelled")),
    "coverage_report": lambda s, d: retrieval.coverage(_docs(s, d)),
    "retrieval_summary": lambda s, d: retrieval.summaries(_docs(s, d)),
    "few_prompt": _few,
    "centroid_scores": lambda s, d: select.centroid_scores(_embeddings(s, d)),
    "semantic_select": lambda s, d: select.semantic(_embeddings(s, d), max_lines=45, max_selected=30, threshold=0.3),
    "pack_chunks": lambda s, d: pack.chunked(_distilled(s, d), "pair_id", "text", 64),
    "pack_items": lambda s, d: pack.packed_items(_pairs(s, d).select("pair_id", T.sentences(F.col("target")).alias("items")), "pair_id", "items", 12),
    "model_comparison": _compared,
    "hierarchical_summary": lambda s, d: pack.summarized(_distilled(s, d), "pair_id", "text", 64),
    "sentence_split": lambda s, d: _pairs(s, d).select("pair_id", F.posexplode(T.sentences(F.col("target"))).alias("pos", "sentence")),
    "sentence_dedup": lambda s, d: _pairs(s, d).select("pair_id", pack.clean_summary(F.col("target"), 0).alias("summary")),
    "clean_output": lambda s, d: _pairs(s, d).select("pair_id", pack.clean_output(F.col("target")).alias("summary")),
    "prompt_block": lambda s, d: _raw_pairs(s, d).select("pair_id", pack.prompt_block(F.coalesce("chat", F.lit("")), 30).alias("block")),
    "zero_prompt": lambda s, d: _raw_pairs(s, d).select("pair_id", pack.zero_prompt(F.coalesce("chat", F.lit(""))).alias("prompt")),
    "pair_load_stats": lambda s, d: corpus.load_stats(_raw_pairs(s, d)),
    "low_info_targets": lambda s, d: _pairs(s, d).where(corpus.low_info(F.col("target"))).select("pair_id", "target"),
    "cap_by_target": lambda s, d: corpus.cap_by_target(_pairs(s, d), 2).select("pair_id", "target"),
    "cap_by_prefix": lambda s, d: corpus.cap_by_prefix(_pairs(s, d), 3).select("pair_id", "target"),
    "duplicate_targets": lambda s, d: corpus.duplicate_targets(_pairs(s, d)),
    "near_duplicate_targets": lambda s, d: corpus.near_duplicates(_pairs(s, d)),
    "train_val_split": lambda s, d: corpus.train_val(_pairs(s, d)).select("pair_id", "part"),
    "stratified_split": lambda s, d: corpus.stratified(_raw_pairs(s, d)),
    "split_totals": lambda s, d: corpus.stratified(_raw_pairs(s, d)).groupBy("part").agg(F.count("*").alias("n")),
    "contiguous_window": lambda s, d: corpus.contiguous(distill.delivered(table(s, d, "chat_log")), 5, 10),
    "opener_diversity": lambda s, d: corpus.opener_diversity(_pairs(s, d)),
    "system_leakage": lambda s, d: corpus.system_leakage(_pairs(s, d)),
}

_known = lambda c: f"list_filter(coalesce({c}, []), lambda x: x IS NOT NULL)"
_mtext = f"CASE WHEN {S.has('x', L.SPACED_BRACKET_LINE)} THEN {S.strip(S.part('x', L.SPACED_BRACKET_LINE, 1))} ELSE {S.strip('x')} END"
_toks = lambda t: f"list_filter({S.words(t)}, lambda w: w NOT IN ({S.listed(L.RETRIEVAL_STOPWORDS)}) AND length(w) >= 2)"
DOCS = f"""SELECT moment_id, labelled, summary, {_toks('t')} AS toks FROM (SELECT moment_id, coalesce({S.strip('abstractive_summary.summary')}, '') <> '' AS labelled, abstractive_summary.summary AS summary,
    array_to_string(list_concat(k, k, list_transform({_known('messages')}[1:40], lambda x: {_mtext})), chr(10)) AS t FROM (SELECT *, {_known('extractive_summary.key_messages')} AS k FROM moment_data))"""
_tf = lambda w: f"SELECT moment_id, token, count(*) AS tf, min(pos) AS place FROM (SELECT moment_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM ({DOCS}) WHERE {w}) GROUP BY moment_id, token"
_idf_sql = f"SELECT token, df, ln((1 + (SELECT count(*) FROM ({DOCS}) WHERE labelled)) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT token, count(*) AS df FROM ({_tf('labelled')}) GROUP BY token)"
_vec = lambda w: f"SELECT moment_id, token, w / CASE WHEN norm > 0 THEN norm ELSE 1 END AS weight FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY moment_id)) AS norm FROM (SELECT moment_id, token, (1 + ln(tf)) * coalesce(idf, 1.0) AS w FROM ({_tf(w)}) LEFT JOIN ({_idf_sql}) USING (token)))"
_ranked = lambda scored: f"SELECT moment_id, example_id, score, row_number() OVER (PARTITION BY moment_id ORDER BY score DESC, example_id) AS rank FROM ({scored}) QUALIFY rank <= 3"
_near_sql = f"""WITH q AS MATERIALIZED ({_vec('moment_id % 50 = 0')}), v AS MATERIALIZED ({_vec('labelled')}), d AS MATERIALIZED ({DOCS}),
    s AS (SELECT q.moment_id, v.moment_id AS example_id, round(sum(q.weight * v.weight), 9) AS score FROM q JOIN v USING (token) GROUP BY ALL)
  SELECT moment_id, example_id, round(score, 6) AS score, rank FROM ({_ranked("SELECT a.moment_id, b.moment_id AS example_id, coalesce(score, 0) AS score FROM d a JOIN d b ON a.moment_id % 50 = 0 AND b.labelled AND a.moment_id <> b.moment_id LEFT JOIN s ON s.moment_id = a.moment_id AND s.example_id = b.moment_id")})"""
_emo = lambda ws: f"len(list_filter(toks, lambda w: w IN ({S.listed(ws)})))"
_emotion = f"SELECT moment_id, CASE WHEN greatest({', '.join(L.EMOTIONS)}) = 0 THEN 'reaction' {' '.join(f'WHEN {k} = greatest({chr(44).join(L.EMOTIONS)}) THEN {S.q(k)}' for k in L.EMOTIONS)} END AS emotion FROM (SELECT moment_id, {', '.join(f'{_emo(ws)} AS {k}' for k, ws in L.EMOTIONS.items())} FROM ({DOCS}))"
_own = _toks("coalesce(summary, '')")
_overlap = f"SELECT moment_id, CASE WHEN len(own) > 0 THEN round(len(list_intersect(own, toks)) / len(own)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS overlap FROM (SELECT moment_id, toks, list_distinct({_own}) AS own FROM ({DOCS}) WHERE labelled)"
_case = lambda m, c: f"CASE {c} " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in m.items()) + " END"
VALID = f"SELECT * FROM (SELECT pair_id, id, {S.strip('chat')} AS chat, {S.strip('summary')} AS target FROM summary_pairs) WHERE chat <> '' AND target <> ''"
_w = S.words("target")
_low = f"({S.has('lower(target)', L.LOW_INFO)} OR len({_w}) < 6 OR len(list_distinct({_w})) <= 2)"
_prefix = lambda n: f"CASE WHEN len({_w}) = 0 THEN {S.strip('lower(target)')} ELSE array_to_string(({_w})[1:{n}], ' ') END"
_source = "CASE WHEN contains(coalesce(id, ''), '_') THEN split_part(id, '_', 1) ELSE 'unknown' END"
_h = S.md5_order(42, "pair_id")
_sent_src = S.squeeze(S.sub(S.strip("target"), rf"(?i)^summary:{L.WS}*"))
_marked = f"regexp_replace({{}}, '([.!?]){L.WS}+', '\\1' || chr(1), 'g')"
_closed = "CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END"
_split = lambda src: f"list_transform(list_filter(list_transform(string_split({_marked.format(src)}, chr(1)), lambda x: {S.strip('x')}), lambda x: x <> ''), lambda x: {_closed})"
_cw = "len(regexp_extract_all({}, '[A-Za-z0-9'']+'))"
_valid_lines = f"SELECT pair_id AS window_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS raw FROM (SELECT pair_id, {S.split_lines('chat')} AS l FROM ({VALID}))"
_cl = S.cleaned(_valid_lines)
_strat = f"SELECT pair_id, source, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.85::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, pair_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT pair_id, {_source} AS source, {_h} AS h FROM summary_pairs))"
_tw = lambda v: f"list_distinct({S.words(v)})"
_both = f"len(list_intersect({_tw('p')}, {_tw('y[1]')}))"
_like = f"(lower(p) = lower(y[1]) OR (len({_tw('p')}) > 0 AND len({_tw('y[1]')}) > 0 AND ({_both} >= 0.86::DOUBLE * (len({_tw('p')}) + len({_tw('y[1]')}) - {_both}) OR {_both} >= 0.92::DOUBLE * least(len({_tw('p')}), len({_tw('y[1]')})))))"
_block = lambda l, n: f"CASE WHEN len({l}) = 0 THEN '- (no usable chat lines)' ELSE array_to_string(list_transform(({l})[1:{n}], lambda x: '- ' || {S.strip('x')}), chr(10)) END"
_zero = f"SELECT pair_id, {S.q(pack.ZERO_HEAD)} || {_block('l', 220)} || {S.q(pack.ZERO_TAIL)} AS prompt FROM (SELECT pair_id, {S.split_lines('chat')} AS l FROM summary_pairs)"
_cut = lambda lines, n: f"SELECT window_id AS pair_id, list(line ORDER BY first_line, copy) AS l FROM (SELECT * FROM ({S.distilled(lines)}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY first_line, copy) <= {n}) GROUP BY window_id"
_few_sql = f"""WITH v AS MATERIALIZED ({VALID}), t AS MATERIALIZED ({_cut(f"SELECT * FROM ({_valid_lines}) WHERE window_id % 50 = 0", 1 << 40)}), short AS MATERIALIZED ({_cut(_valid_lines, 30)}),
    tf AS MATERIALIZED (SELECT pair_id, token, count(*) AS n FROM (SELECT pair_id, unnest({_toks('chat')}) AS token FROM v) GROUP BY ALL), idf AS MATERIALIZED (SELECT token, ln((1 + (SELECT count(*) FROM v)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY token),
    qf AS (SELECT pair_id, token, count(*) AS n FROM (SELECT pair_id, unnest({_toks('array_to_string(l, chr(10))')}) AS token FROM t) GROUP BY ALL),
    dv AS MATERIALIZED (SELECT pair_id, token, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY pair_id)), 1e-300) AS weight FROM (SELECT pair_id, token, (1 + ln(n)) * coalesce(idf, 1.0) AS w FROM tf LEFT JOIN idf USING (token))),
    qv AS MATERIALIZED (SELECT pair_id, token, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY pair_id)), 1e-300) AS weight FROM (SELECT pair_id, token, (1 + ln(n)) * coalesce(idf, 1.0) AS w FROM qf LEFT JOIN idf USING (token))),
    s AS (SELECT qv.pair_id, dv.pair_id AS example_id, round(sum(qv.weight * dv.weight), 9) AS score FROM qv JOIN dv USING (token) GROUP BY ALL),
    near AS ({_ranked("SELECT t.pair_id AS moment_id, v.pair_id AS example_id, coalesce(score, 0) AS score FROM t JOIN v ON t.pair_id <> v.pair_id LEFT JOIN s ON s.pair_id = t.pair_id AND s.example_id = v.pair_id")}),
    shown AS (SELECT moment_id, string_agg({S.q(pack.FEW_CHAT)} || {_block('coalesce(short.l, [])', 30)} || {S.q(pack.FEW_SUMMARY)} || target || chr(10), chr(10) ORDER BY rank) AS examples FROM near JOIN v ON v.pair_id = example_id LEFT JOIN short ON short.pair_id = example_id GROUP BY moment_id)
  SELECT t.pair_id, {S.q(pack.RULES + chr(10) * 2 + pack.FEW_HEAD)} || examples || {S.q(pack.FEW_TARGET)} || {_block('l', 220)} || {S.q(pack.FEW_TAIL)} AS prompt FROM t JOIN shown ON moment_id = t.pair_id"""
# Folds over a row's list: each element is a state of one group, neighbours merge while the budget holds.
_fold = lambda states, joint, budget: f"list_reduce({states}, lambda a, b: CASE WHEN a.held AND b.held AND a.used + b.used <= {budget} THEN {{'g': list_concat(a.g[1:len(a.g) - 1], [a.g[len(a.g)] || {joint} || b.g[1]]), 'n': list_concat(a.n[1:len(a.n) - 1], [a.n[len(a.n)] + b.n[1]]), 'used': a.used + b.used, 'held': true}} ELSE {{'g': list_concat(a.g, b.g), 'n': list_concat(a.n, b.n), 'used': b.used, 'held': b.held}} END)"
_count = lambda x: f"len({S.tokens(x)})"
_pieces = lambda x, b: f"list_transform(range(0, {_count(x)}, {b}), lambda i: array_to_string(({S.tokens(x)})[i + 1:i + {b}], ' '))"
_chunk_states = f"list_transform(list_filter(l, lambda x: {_count('x')} > 0), lambda x: CASE WHEN {_count('x')} > 62 THEN {{'g': {_pieces('x', 62)}, 'n': list_transform({_pieces('x', 62)}, lambda y: 1::BIGINT), 'used': 0::BIGINT, 'held': false}} ELSE {{'g': [x], 'n': [1::BIGINT], 'used': {_count('x')} + 1, 'held': true}} END)"
_texts = f"SELECT window_id AS pair_id, list(line ORDER BY first_line, copy) AS l FROM ({S.distilled(S.pair_lines())}) GROUP BY window_id"
_chunked = f"SELECT pair_id, CASE WHEN len(st) = 0 THEN []::VARCHAR[] ELSE ({_fold('st', 'chr(10)', 62)}).g END AS g FROM (SELECT pair_id, {_chunk_states} AS st FROM ({_texts}))"
_item_states = lambda xs, b: f"list_transform(list_filter(list_transform({xs}, lambda x: {S.strip('x')}), lambda x: {_count('x')} > 0), lambda x: {{'g': [CASE WHEN {_count('x')} > {b} THEN array_to_string(({S.tokens('x')})[1:{b}], ' ') ELSE x END], 'n': [1::BIGINT], 'used': least({_count('x')}, {b}) + 1, 'held': true}})"
_items = f"SELECT pair_id, {_fold('st', 'chr(32)', 12)} AS f FROM (SELECT pair_id, {_item_states('l', 12)} AS st FROM (SELECT pair_id, {_split(_sent_src)} AS l FROM ({VALID}))) WHERE len(st) > 0"
_first = lambda p: f"array_to_string(({S.tokens(f'split_part(regexp_replace({S.strip(p)}, {S.q(chr(40) + chr(91) + chr(46) + chr(33) + chr(63) + chr(93) + chr(41) + L.WS + chr(43))}, {S.q(chr(92) + chr(49) + chr(1))}), chr(1), 1)')})[1:24], ' ')"
_gen = lambda xs: f"list_transform({xs}, lambda p: {_first('p')})"
_hier = f"""WITH RECURSIVE c AS MATERIALIZED ({_chunked}), h AS (SELECT pair_id, 0 AS round, CASE WHEN len(now) > 0 AND len(list_distinct(list_filter(now, lambda x: x <> ''))) <= 1 THEN [coalesce(list_filter(now, lambda x: x <> '')[1], '')] ELSE now END AS now FROM (SELECT pair_id, {_gen('g')} AS now FROM c)
    UNION ALL SELECT pair_id, round + 1, CASE WHEN len(st) = 0 THEN [''] WHEN len(f.g) < len(now) THEN {_gen('f.g')} ELSE {_gen(f"[array_to_string({_gen('f.g')}, ' ')]")} END FROM (SELECT *, CASE WHEN len(st) > 0 THEN {_fold('st', 'chr(32)', 40)} END AS f FROM (SELECT *, {_item_states('now', 40)} AS st FROM h WHERE len(now) > 1 AND round < {pack.MAX_ROUNDS}))),
    r AS (SELECT pair_id, coalesce(max_by(now, round)[1], '') AS raw FROM h GROUP BY pair_id), sp AS (SELECT pair_id, {_split(_sent_src).replace('target', 'raw')} AS l FROM r)
  SELECT pair_id, CASE WHEN len(l) = 0 THEN '' ELSE array_to_string((list_reduce(list_transform(l, lambda s: [s]), lambda k, y: CASE WHEN len(list_filter(k, lambda p: {_like})) > 0 THEN k ELSE list_concat(k, y) END))[1:2], ' ') END AS summary FROM sp"""
_dot = lambda a, b: f"list_sum(list_transform({a}, lambda x, i: x * {b}[i]))"
_greedy = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 45),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
    r AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY round({_dot('v', 'c')} / greatest(sqrt({_dot('c', 'c')}), 1e-8), 6) DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM e JOIN c USING (label)),
    g AS (SELECT DISTINCT label, 0::BIGINT AS k, n, []::DOUBLE[][] AS taken, []::BIGINT[] AS ids FROM r WHERE n > 30 UNION ALL SELECT g.label, g.k + 1, g.n, CASE WHEN ok THEN list_concat(taken, [v]) ELSE taken END, CASE WHEN ok THEN list_concat(ids, [vec_id]) ELSE ids END
      FROM (SELECT g.*, r.v, r.vec_id, len(taken) < 30 AND coalesce(list_max(list_transform(taken, lambda t: list_inner_product(t, r.v))) < 0.3::DOUBLE, true) AS ok FROM g JOIN r ON r.label = g.label AND r.k = g.k + 1) g)
  SELECT unnest(ids) AS vec_id, label FROM g WHERE k = n UNION ALL SELECT vec_id, label FROM r WHERE n <= 30"""
ORACLES = {
    "tfidf_idf": f"SELECT token, df, round(idf, 6) AS idf FROM ({_idf_sql})",
    "tfidf_vectors": f"SELECT moment_id, token, round(weight, 6) AS weight FROM ({_vec('labelled')})",
    "nearest_examples": _near_sql,
    "emotion_label": _emotion,
    "top_terms": f"SELECT moment_id, rank, token, tf FROM (SELECT *, row_number() OVER (PARTITION BY moment_id ORDER BY tf DESC, place) AS rank FROM ({_tf('true')})) WHERE rank <= 3",
    "overlap_proxy": _overlap,
    "coverage_report": f"SELECT moments, labelled, round(labelled / greatest(moments, 1)::DOUBLE, 6) AS coverage, round(coalesce(l, 0), 6) AS mean_length, round(coalesce(o, 0), 6) AS mean_overlap FROM (SELECT count(*) AS moments, count(*) FILTER (labelled) AS labelled FROM ({DOCS})), (SELECT avg(length(summary)) AS l, avg(overlap) AS o FROM ({DOCS}) JOIN ({_overlap}) USING (moment_id))",
    "retrieval_summary": f"SELECT moment_id, 'On ' || coalesce(token, 'the moment') || ' chat showed ' || s || '; repeated lines point to ' || {_case(L.INTERPRETATIONS, 's')} || '.' AS summary FROM (SELECT moment_id, {_case(L.EMOTION_SENTIMENT, 'emotion')} AS s FROM ({_emotion})) JOIN (SELECT moment_id FROM ({DOCS}) WHERE NOT labelled) USING (moment_id) LEFT JOIN (SELECT moment_id, min_by(token, (-tf, place)) AS token FROM ({_tf('NOT labelled')}) GROUP BY moment_id) USING (moment_id)",
    "centroid_scores": "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * c[i])) / greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-8), 6) AS score FROM embeddings JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) USING (label)",
    "sentence_split": f"SELECT pair_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT pair_id, {_split(_sent_src)} AS l FROM ({VALID}))",
    "sentence_dedup": f"SELECT pair_id, array_to_string(list_reduce(list_transform(l, lambda s: [s]), lambda k, y: CASE WHEN len(list_filter(k, lambda p: {_like})) > 0 THEN k ELSE list_concat(k, y) END), ' ') AS summary FROM (SELECT pair_id, {_split(_sent_src)} AS l FROM ({VALID})) WHERE len(l) > 0 UNION ALL SELECT pair_id, '' FROM (SELECT pair_id, {_split(_sent_src)} AS l FROM ({VALID})) WHERE len(l) = 0",
    "clean_output": f"SELECT pair_id, array_to_string(({_split(S.squeeze('target'))})[1:2], ' ') AS summary FROM ({VALID})",
    "prompt_block": f"SELECT pair_id, CASE WHEN len(l) = 0 THEN '- (no usable chat lines)' ELSE array_to_string(list_transform(l[1:30], lambda x: '- ' || {S.strip('x')}), chr(10)) END AS block FROM (SELECT pair_id, {S.split_lines('chat')} AS l FROM summary_pairs)",
    "few_prompt": _few_sql,
    "zero_prompt": _zero,
    "semantic_select": _greedy,
    "pack_chunks": f"SELECT pair_id, generate_subscripts(g, 1) AS chunk_no, unnest(g) AS chunk, len({S.tokens('unnest(g)')}) AS n_tokens FROM ({_chunked})",
    "pack_items": f"SELECT pair_id, generate_subscripts(f.g, 1) AS group_no, unnest(f.g) AS text, unnest(f.n) AS n_items FROM ({_items})",
    "hierarchical_summary": _hier,
    "model_comparison": f"SELECT pair_id, to_json({{'lines': len(l), 'model': {{'chunks': len(g), 'summary': summary}}}})::VARCHAR AS result FROM ({_hier}) JOIN ({_chunked}) USING (pair_id) JOIN ({_texts}) USING (pair_id)",
    "pair_load_stats": f"""WITH v AS (SELECT * FROM ({VALID})), c AS (SELECT * FROM ({_cl})), g AS (SELECT window_id, status, CASE WHEN status = 'kept' THEN key END AS k, count(*) AS n, sum(runs) AS runs, min_by(payload, line_no) AS line FROM c GROUP BY ALL),
      s AS (SELECT window_id, sum(CASE WHEN status = 'system' THEN n ELSE 0 END) AS sys, sum(CASE WHEN status = 'empty' THEN n ELSE 0 END) AS emp, sum(CASE WHEN status = 'kept' AND n >= 3 THEN n - 1 ELSE 0 END) AS dl, count(*) FILTER (status = 'kept' AND n >= 3) AS dg, sum(runs) AS fl,
        sum(CASE WHEN status <> 'kept' THEN NULL WHEN n >= 3 THEN {_cw.format("line || ' x' || n")} ELSE n * {_cw.format('line')} END) AS wa, sum(CASE WHEN status <> 'kept' THEN NULL WHEN n >= 3 THEN 1 ELSE n END) AS la FROM g GROUP BY window_id),
      r AS (SELECT {_cw.format('chat')} AS wb, len({S.split_lines('chat')}) AS lb, {_low} AS low, s.* FROM v LEFT JOIN s ON s.window_id = v.pair_id),
      t AS (SELECT (SELECT count(*) FROM summary_pairs WHERE chat IS NOT NULL AND summary IS NOT NULL) AS examples_seen, sum(wb)::BIGINT AS source_words_before, sum(lb)::BIGINT AS source_lines_before, sum(sys)::BIGINT AS removed_system_lines, sum(emp)::BIGINT AS removed_empty_lines,
        sum(dl)::BIGINT AS collapsed_duplicate_lines, sum(dg)::BIGINT AS collapsed_duplicate_groups, sum(fl)::BIGINT AS collapsed_token_flood_runs, count(*) FILTER (wa IS NULL) AS dropped_empty_source, count(*) FILTER (wa IS NOT NULL AND low) AS dropped_low_info_targets,
        count(*) FILTER (wa IS NOT NULL AND NOT low) AS kept_pairs, coalesce(sum(wa) FILTER (NOT low), 0)::BIGINT AS source_words_after, coalesce(sum(la) FILTER (NOT low), 0)::BIGINT AS source_lines_after FROM r)
      SELECT *, round(source_words_after / greatest(kept_pairs, 1)::DOUBLE, 6) AS mean_words_after, round(source_lines_after / greatest(kept_pairs, 1)::DOUBLE, 6) AS mean_lines_after FROM t""",
    "low_info_targets": f"SELECT pair_id, target FROM ({VALID}) WHERE {_low}",
    "cap_by_target": f"SELECT pair_id, target FROM ({VALID}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY {_h}, pair_id) <= 2",
    "cap_by_prefix": f"SELECT pair_id, target FROM ({VALID}) QUALIFY row_number() OVER (PARTITION BY {_prefix(4)} ORDER BY {_h}, pair_id) <= 3",
    "duplicate_targets": f"SELECT count(*) AS targets, count(*) FILTER (n > 1) AS repeated_targets, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicate_targets FROM (SELECT target, count(*) AS n FROM ({VALID}) GROUP BY target)",
    "near_duplicate_targets": f"""WITH t AS MATERIALIZED (SELECT pair_id, list_sort(list_distinct({_w})) AS w, lower(target) AS low FROM ({VALID})), c AS MATERIALIZED (SELECT CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE ' ' || low END AS said, min(pair_id) AS class_id, any_value(w) AS w FROM t GROUP BY said),
      l AS (SELECT a.class_id, count(*) AS links FROM c a JOIN c b ON a.class_id <> b.class_id AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.92::DOUBLE * least(len(a.w), len(b.w)) GROUP BY a.class_id)
      SELECT pair_id, class_id, coalesce(links, 0) AS links FROM t JOIN c ON c.said = CASE WHEN len(t.w) > 0 THEN array_to_string(t.w, ' ') ELSE ' ' || low END LEFT JOIN l USING (class_id)""",
    "train_val_split": f"SELECT pair_id, CASE WHEN r <= least(greatest(floor(n * 0.1::DOUBLE), 1), n - 1) THEN 'val' ELSE 'train' END AS part FROM (SELECT pair_id, row_number() OVER (ORDER BY {_h}, pair_id) AS r, count(*) OVER () AS n FROM ({VALID}))",
    "stratified_split": _strat,
    "split_totals": f"SELECT part, count(*) AS n FROM ({_strat}) GROUP BY part",
    "contiguous_window": f"SELECT window_id, line_no, raw FROM ({S.delivered()}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY line_no) BETWEEN 6 AND 15",
    "opener_diversity": f"SELECT {_prefix(3)} AS opener, count(*) AS n FROM ({VALID}) GROUP BY 1",
    "system_leakage": f"SELECT {_source} AS source, count(*) AS pairs, count(*) FILTER ({S.has('lower(target)', L.DISTILL_SYSTEM)}) AS leaking FROM ({VALID}) GROUP BY 1",
}
