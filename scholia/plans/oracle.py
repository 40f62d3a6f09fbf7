"""DuckDB SQL for the queries of the suite, written apart from the DataFrame plans."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
AGE = f"((epoch_us({NOW}) - t_us) / 86400000000.0)"
EVENTS = """
ev0 AS (SELECT user_id AS learner_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value, ts, epoch_us(ts) AS t_us FROM events),
ev AS (SELECT learner_id, event_id, 'c' || CAST(k % 20 AS VARCHAR) AS concept_id,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'answer' WHEN event_type = 'view' THEN 'watch' WHEN event_type = 'error' THEN 'affect' ELSE 'session_end' END AS kind,
    CASE WHEN event_type IN ('purchase', 'click') THEN least(1.0, value / 250) END AS outcome,
    ['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'][k % 6 + 1] AS bloom, CAST(1 + k % 5 AS DOUBLE) AS difficulty,
    CASE event_type WHEN 'error' THEN 'frustrated' WHEN 'purchase' THEN 'happy' WHEN 'click' THEN 'engaged' END AS affect,
    value AS duration_sec, ts, t_us, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS seq
  FROM (SELECT *, learner_id AS user_id FROM ev0))"""
CLIP = "greatest(0.0, least(1.0, {}))"
MASTERY = f"""
ms AS (SELECT learner_id, concept_id, count(*) AS attempts, count(*) FILTER (kind = 'answer' AND outcome >= 0.5) AS correct, count(*) FILTER (kind = 'answer') AS answers, max_by(t_us, seq) AS last_us,
    sum(CASE WHEN kind = 'answer' THEN exp(-{AGE} / 7.0) END) AS w, sum(CASE WHEN kind = 'answer' THEN exp(-{AGE} / 7.0) * outcome END) AS wo,
    avg(CASE WHEN bloom IN ('apply', 'analyze', 'evaluate', 'create') THEN outcome END) AS app FROM ev GROUP BY ALL),
mp AS (SELECT learner_id, concept_id, attempts, correct / attempts AS accuracy, CASE WHEN w > 0 THEN {CLIP.format('wo / w')} ELSE correct / attempts END AS confidence,
    greatest(0.1, exp(-((epoch_us({NOW}) - last_us) / 86400000000.0) / 14.0)) AS retention, {CLIP.format('coalesce(app, 0.0)')} AS application, answers >= 3 AS confident FROM ms),
mastered AS (SELECT *, {CLIP.format('0.25 * accuracy + 0.25 * confidence + 0.30 * retention + 0.20 * application')} AS mastery FROM mp)"""
VALENCE = "CASE lower(trim({0})) WHEN 'excited' THEN 1.0 WHEN 'confident' THEN 0.95 WHEN 'engaged' THEN 0.9 WHEN 'happy' THEN 0.85 WHEN 'curious' THEN 0.8 WHEN 'neutral' THEN 0.6 WHEN 'bored' THEN 0.45 WHEN 'surprised' THEN 0.4 WHEN 'tired' THEN 0.3 WHEN 'frustrated' THEN 0.25 WHEN 'anxious' THEN 0.2 WHEN 'stressed' THEN 0.2 WHEN 'angry' THEN 0.15 ELSE 0.6 END"
AROUSAL = "CASE lower(trim({0})) WHEN 'excited' THEN 0.9 WHEN 'angry' THEN 0.9 WHEN 'happy' THEN 0.7 WHEN 'engaged' THEN 0.7 WHEN 'curious' THEN 0.7 WHEN 'confident' THEN 0.6 WHEN 'bored' THEN 0.35 WHEN 'tired' THEN 0.25 WHEN 'stressed' THEN 0.85 WHEN 'anxious' THEN 0.85 ELSE 0.5 END"
EDGES = """
st AS (SELECT concept_id AS source, lead(concept_id) OVER (PARTITION BY learner_id ORDER BY t_us, event_id) AS target FROM ev),
ed AS (SELECT source, target, count(*) AS occurrences FROM st WHERE target IS NOT NULL AND source <> target GROUP BY ALL)"""
FORWARD = "fw AS (SELECT source, target, occurrences FROM ed WHERE CAST(substr(source, 2) AS INTEGER) < CAST(substr(target, 2) AS INTEGER))"
CHUNKS = """
ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
ch AS (SELECT doc_id || ':' || pos AS id, doc_id AS document_id, pos, 1 + pos // 5 AS page, source AS heading, text FROM ln)"""
TOK = "regexp_extract_all(lower({0}), '([a-z0-9]+)', 1)"
POST = f"""
tk AS (SELECT id, document_id, len({TOK.format("concat_ws(' ', heading, text)")}) AS length, unnest({TOK.format("concat_ws(' ', heading, text)")}) AS token FROM ch),
po AS (SELECT token, id, document_id, length, count(*) AS tf FROM tk GROUP BY ALL),
le AS (SELECT count(*) AS n, avg(len({TOK.format("concat_ws(' ', heading, text)")})) AS mean, count(DISTINCT document_id) AS d FROM ch),
qs(query_id, query) AS (VALUES (1, 'the idiot of things'), (2, 'theory and nation src3'), (3, 'la tion des'), (4, 'version license public')),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS token FROM qs) GROUP BY ALL)"""


def bm25(limit: int) -> str:
    return f"""
bh AS (SELECT po.*, query_id FROM po JOIN qt USING (token)),
bd AS (SELECT query_id, token, count(*) AS df FROM bh GROUP BY ALL),
bs AS (SELECT query_id, id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM bh JOIN bd USING (query_id, token), le GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bs) WHERE rank <= {limit})"""


def tfidf(limit: int) -> str:
    return f"""
dt AS (SELECT document_id, token, sum(tf) AS tf FROM po GROUP BY ALL),
nm AS (SELECT document_id, sqrt(sum(tf * tf)) AS norm FROM dt GROUP BY ALL),
td AS (SELECT token, count(*) AS df FROM po WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
ts AS (SELECT query_id, document_id, sum(qtf * tf / norm * (ln((d + 1) / (df + 1)) + 1)) AS score FROM dt JOIN qt USING (token) JOIN td USING (token) JOIN nm USING (document_id), le GROUP BY ALL),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) AS doc_rank FROM ts) WHERE doc_rank <= {limit}),
tf3 AS (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS p FROM ch WHERE document_id IN (SELECT document_id FROM tr)),
ti AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, p) AS rank FROM tr JOIN tf3 USING (document_id) WHERE p <= 3)"""


ANSWERS = """
an AS (SELECT o_custkey AS student, strftime(o_orderdate, '%Y-%m') AS assessment, p_brand AS concept, CAST(l_quantity AS DOUBLE) AS awarded, 50.0 AS max_marks, l_returnflag || l_linestatus AS gap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
QUESTIONS = """
qu AS (SELECT p_partkey AS id, p_brand AS chapter, CAST(1 + p_size % 5 AS BIGINT) AS marks, CAST(p_retailprice AS DOUBLE) / (SELECT max(CAST(p_retailprice AS DOUBLE)) FROM part) AS quality,
  ['easy', 'medium', 'hard'][p_size % 3 + 1] AS difficulty, ['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'][p_size % 6 + 1] AS bloom, p_name AS stem FROM part)"""
STOP = "('the','a','an','of','in','is','are','to','and','or','for','on','at','it','its','this','that','which','with','from','by','as','be','following')"
NORM = "trim(regexp_replace(lower({0}), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
LABELS = "('the'), ('of'), ('and'), ('idiot'), ('clown'), ('license'), ('version'), ('est'), ('der'), ('tion')"
FOUND = f"""
lb(label) AS (VALUES {LABELS}),
fo AS (SELECT DISTINCT c.id, c.document_id, c.page, c.heading, t.label FROM (SELECT *, unnest(list_distinct({TOK.format('text')})) AS label FROM ch) c JOIN lb t USING (label)),
co AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM fo a JOIN fo b ON a.id = b.id AND a.label < b.label GROUP BY ALL),
fp AS (SELECT label, document_id, min(page) AS page FROM fo GROUP BY ALL),
ov AS (SELECT x.label AS a, y.label AS b, count(*) FILTER (x.page < y.page) AS ahead, count(*) FILTER (x.page >= y.page) AS behind FROM fp x JOIN fp y ON x.document_id = y.document_id AND x.label < y.label GROUP BY ALL),
eh AS (SELECT label, heading, count(*) AS n FROM fo GROUP BY ALL),
en AS (SELECT label, CAST(sum(n) AS BIGINT) AS chunks, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM eh GROUP BY ALL),
vt AS (SELECT co.a, co.b, CASE WHEN ahead > behind THEN 1 WHEN ahead < behind THEN -1 ELSE 0 END AS t, CASE WHEN x.entropy - y.entropy > 1e-9 THEN 1 WHEN x.entropy - y.entropy < -1e-9 THEN -1 ELSE 0 END AS e
  FROM co JOIN ov USING (a, b) JOIN en x ON x.label = co.a JOIN en y ON y.label = co.b WHERE n >= 2),
vs AS (SELECT *, (t > 0)::INT * WT + (e > 0)::INT * WB AS va, (t < 0)::INT * WT + (e < 0)::INT * WB AS vb FROM vt WHERE abs(t) + abs(e) >= 2),
vw AS (SELECT CASE WHEN va > vb THEN a ELSE b END AS prerequisite, CASE WHEN va > vb THEN b ELSE a END AS concept, abs(va - vb) / (va + vb) AS score, CAST(greatest(va, vb) AS BIGINT) AS weight, CAST(least(va, vb) AS BIGINT) AS against FROM vs WHERE abs(va - vb) / (va + vb) >= 0.28)"""


def w(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


ORACLE_SQL: dict[str, str] = {
    "learner_stats": w(EVENTS) + " SELECT learner_id, count(*) AS events, count(*) FILTER (kind = 'answer' AND outcome >= 0.5) AS correct, min(t_us) AS first_us, max(t_us) AS last_us, count(DISTINCT concept_id) AS concepts, count(*) FILTER (kind = 'answer') AS n_answer, count(*) FILTER (kind = 'watch') AS n_watch, count(*) FILTER (kind = 'affect') AS n_affect, count(*) FILTER (kind = 'session_end') AS n_session_end FROM ev GROUP BY ALL",
    "learner_replay": w(EVENTS) + " SELECT learner_id, concept_id, count(*) AS attempts, count(*) FILTER (kind = 'answer' AND outcome >= 0.5) AS correct, max_by(t_us, seq) AS last_seen_us FROM ev GROUP BY ALL",
    "mastery": w(EVENTS, MASTERY) + " SELECT * FROM mastered",
    "mastery_status": w(EVENTS, MASTERY) + " SELECT learner_id, concept_id, mastery, CASE WHEN NOT confident THEN 'learning' WHEN mastery >= 0.85 THEN 'mastered' WHEN mastery >= 0.7 THEN 'proficient' WHEN mastery >= 0.55 THEN 'developing' ELSE 'needsReview' END AS status FROM mastered",
    "weak_concepts": w(EVENTS, MASTERY) + " SELECT learner_id, concept_id, mastery, rank FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY mastery, concept_id) AS rank FROM mastered WHERE mastery < 0.55) WHERE rank <= 5",
    "overall_mastery": w(EVENTS, MASTERY) + " SELECT learner_id, avg(mastery) AS mastery, count(*) AS concepts FROM mastered GROUP BY ALL",
    "emotion_summary": w(EVENTS) + f""",
e1 AS (SELECT learner_id, concept_id, nullif(trim(lower(affect)), '') AS tag, {VALENCE.format('affect')} AS v, {AROUSAL.format('affect')} AS a FROM ev),
e2 AS (SELECT learner_id, concept_id, count(*) AS n, round(avg(v), 9) AS valence, round(avg(a), 9) AS arousal, avg((v >= 0.55)::INT) AS positive_ratio FROM e1 GROUP BY GROUPING SETS ((learner_id, concept_id), (learner_id))),
e3 AS (SELECT learner_id, concept_id, tag, count(*) AS c FROM e1 WHERE tag IS NOT NULL GROUP BY GROUPING SETS ((learner_id, concept_id, tag), (learner_id, tag))),
e4 AS (SELECT learner_id, concept_id, arg_min(tag, (-c, tag)) AS tag, max(c) / sum(c) AS part FROM e3 GROUP BY ALL)
SELECT e2.*, CASE WHEN part >= 0.6 THEN tag END AS dominant FROM e2 LEFT JOIN e4 ON e2.learner_id = e4.learner_id AND e2.concept_id IS NOT DISTINCT FROM e4.concept_id""",
    "lifelong_years": w(EVENTS) + ", y AS (SELECT *, year(ts) - (month(ts) < 4)::INT AS y0 FROM ev) SELECT learner_id, printf('%d-%02d', y0, (y0 + 1) % 100) AS year, count(*) AS events, count(DISTINCT concept_id) AS concepts, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) FILTER (kind = 'answer' AND outcome IS NOT NULL) AS answers, count(*) FILTER (kind = 'answer' AND outcome >= 0.5) AS correct, coalesce(count(*) FILTER (kind = 'answer' AND outcome >= 0.5) / nullif(count(*) FILTER (kind = 'answer' AND outcome IS NOT NULL), 0), 0.0) AS accuracy FROM y GROUP BY learner_id, y0",
    "concept_continuity": w(EVENTS) + ", p AS (SELECT learner_id, concept_id, CAST(floor(t_us / 604800000000.0) AS BIGINT) AS period, coalesce(count(*) FILTER (kind = 'answer' AND outcome >= 0.5) / nullif(count(*) FILTER (kind = 'answer' AND outcome IS NOT NULL), 0), 0.0) AS accuracy FROM ev GROUP BY ALL) SELECT learner_id, concept_id, count(*) AS periods, min_by(accuracy, period) AS first_accuracy, max_by(accuracy, period) AS last_accuracy, max_by(accuracy, period) - min_by(accuracy, period) AS improves FROM p GROUP BY ALL HAVING count(*) > 1",
    "habit_streaks": w(EVENTS) + f""",
hd AS (SELECT DISTINCT learner_id, CAST(floor(t_us / 86400000000.0) AS BIGINT) AS day FROM ev WHERE t_us <= epoch_us({NOW})),
hi AS (SELECT *, day - row_number() OVER (PARTITION BY learner_id ORDER BY day) AS island FROM hd),
ht AS (SELECT CAST(floor(epoch_us({NOW}) / 86400000000.0) AS BIGINT) AS today),
hr AS (SELECT learner_id, island, count(*) AS length, max(day) AS last, count(*) FILTER (today - day < 7) AS d7, count(*) FILTER (today - day < 30) AS d30 FROM hi, ht GROUP BY learner_id, island),
hs AS (SELECT learner_id, CAST(sum(length) AS BIGINT) AS total_days, max(length) AS longest_streak, max_by(length, last) AS run, max(last) AS last, sum(d7) / 7 AS c7, sum(d30) / 30 AS c30 FROM hr GROUP BY ALL)
SELECT learner_id, total_days, CASE WHEN today - last <= 1 THEN run ELSE 0 END AS current_streak, longest_streak, c7 AS consistency_7, c30 AS consistency_30, CASE WHEN c7 < 0.4 THEN 'relapse' WHEN total_days <= 21 THEN 'forming' WHEN total_days <= 66 THEN 'consolidating' ELSE 'automated' END AS phase, greatest(1 - c7, least((today - last) / 3, 1.0)) AS risk FROM hs, ht""",
    "attention_curve": w(EVENTS) + """,
a1 AS (SELECT learner_id, CAST(floor(t_us / 86400000000.0) AS BIGINT) AS day, event_id, t_us, CASE affect WHEN 'frustrated' THEN 1.8 WHEN 'engaged' THEN 0.8 WHEN 'happy' THEN 0.7 ELSE 1.0 END AS h FROM ev),
a2 AS (SELECT learner_id, day, event_id, t_us, round(avg(h) OVER r, 4) AS hazard, (t_us - min(t_us) OVER r) / 60000000.0 AS minutes FROM a1 WINDOW r AS (PARTITION BY learner_id, day ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)),
a3 AS (SELECT *, min(greatest(0.0, least(1.0, 1 - pow(minutes / (25.0 / hazard), 1.7)))) OVER (PARTITION BY learner_id, day ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS attention FROM a2)
SELECT learner_id, day, event_id, minutes, hazard, attention, CASE WHEN attention < 0.2 THEN 'fatigued' WHEN attention < 0.5 THEN 'resting' WHEN attention >= 0.7 THEN 'focused' ELSE 'waning' END AS state, 20 * greatest(0.7 - attention, 0.0) / 0.7 AS rest_minutes FROM a3""",
    "forgetting_exponential": w(EVENTS) + f", x AS (SELECT learner_id, concept_id, exp(sum(CASE WHEN kind = 'answer' AND outcome >= 0.5 THEN ln(2.2) WHEN kind = 'answer' AND outcome IS NOT NULL THEN -0.8 ELSE 0.0 END)) AS strength, max_by(t_us, seq) AS last_us FROM ev GROUP BY ALL) SELECT learner_id, concept_id, strength, greatest(0.05, exp(-((epoch_us({NOW}) - last_us) / 86400000000.0) / strength)) AS retention FROM x",
    "momentum": w(EVENTS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY learner_id, concept_id ORDER BY seq DESC) AS n FROM ev WHERE kind = 'answer' AND outcome IS NOT NULL) SELECT learner_id, concept_id, avg((outcome >= 0.5)::INT) AS momentum FROM r WHERE n <= 5 GROUP BY ALL",
    "session_windows": w(EVENTS) + ", g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY learner_id ORDER BY t_us, event_id) < 7200000000 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY learner_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT learner_id, min(t_us) AS start_us, max(t_us) + 7200000000 AS end_us, count(*) AS events FROM s GROUP BY learner_id, k",
    "graph_degree": w(EVENTS, EDGES) + " SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM (SELECT target AS id, 1 AS i, 0 AS o, occurrences FROM ed UNION ALL SELECT source, 0, 1, occurrences FROM ed) GROUP BY ALL",
    "concept_spine": w(EVENTS, EDGES) + ", l AS (SELECT id, other, sum(occurrences) AS n FROM (SELECT source AS id, target AS other, occurrences FROM ed UNION ALL SELECT target, source, occurrences FROM ed) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, other) AS r FROM l) SELECT id, count(*) AS degree, CAST(sum(n) AS BIGINT) AS occurrences, string_agg(other, ',' ORDER BY r) FILTER (r <= 5) AS neighbours FROM r GROUP BY id ORDER BY degree DESC, occurrences DESC, id LIMIT 10",
    "bfs_neighbors": w(EVENTS, EDGES, FORWARD) + ", nx AS (SELECT source, target FROM fw), b AS (SELECT source AS f, target AS t FROM nx UNION SELECT target, source FROM nx), r(start, id, depth) AS (SELECT 'c0', 'c0', 0 UNION SELECT r.start, b.t, r.depth + 1 FROM r JOIN b ON r.id = b.f WHERE r.depth < 3) SELECT start, id, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE id <> 'c0' GROUP BY start, id",
    "graph_paths": w(EVENTS, EDGES, FORWARD) + ", nx AS (SELECT source, target FROM fw), r(path, cur, hops, nodes) AS (SELECT source || '>' || target, target, 1, [source, target] FROM nx WHERE source = 'c0' UNION ALL SELECT path || '>' || target, target, hops + 1, list_append(nodes, target) FROM r JOIN nx ON r.cur = nx.source WHERE hops < 4 AND cur <> 'c19' AND NOT list_contains(nodes, target)) SELECT path, CAST(hops AS BIGINT) AS hops FROM r WHERE cur = 'c19'",
    "prereq_closure": w(EVENTS, EDGES, FORWARD) + ", p AS (SELECT target AS concept, source AS prerequisite, occurrences / max(occurrences) OVER () AS score FROM fw), u AS (SELECT * FROM p UNION ALL SELECT a.concept, b.prerequisite, a.score * b.score FROM p a JOIN p b ON a.prerequisite = b.concept WHERE a.concept <> b.prerequisite AND a.score * b.score >= 0.28) SELECT concept, prerequisite, max(score) AS score FROM u GROUP BY ALL",
    "topo_levels": w(EVENTS, EDGES, FORWARD) + ", r(id, level) AS (SELECT DISTINCT source, 0 FROM fw WHERE source NOT IN (SELECT target FROM fw) UNION SELECT target, level + 1 FROM r JOIN fw ON r.id = fw.source) SELECT id, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY id",
    "bm25_search": w(CHUNKS, POST, bm25(20)) + " SELECT query_id, id, score, rank FROM bm",
    "tfidf_search": w(CHUNKS, POST, tfidf(20)) + " SELECT query_id, id, score, rank FROM ti",
    "rrf_search": w(CHUNKS, POST, bm25(24), tfidf(24)) + " SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM ti) GROUP BY ALL",
    "hybrid_search": w(CHUNKS, POST, bm25(24), tfidf(24)) + f""",
ff AS (SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM ti) GROUP BY ALL),
kw AS (SELECT query_id, list_filter({TOK.format('query')}, lambda t: t NOT IN ('the','a','an','of','in','for','on','what','how','why','is','are','to','and','or','explain','define','list','state','describe'))[1:5] AS keys FROM qs),
hy AS (SELECT query_id, id, score + 0.15 * len(list_filter(keys, lambda k: contains(lower(concat_ws(' ', heading, text)), k))) AS score FROM ff JOIN ch USING (id) JOIN kw USING (query_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hy) WHERE rank <= 12""",
    "heading_rerank": w(CHUNKS, POST, bm25(20)) + ", hp AS (SELECT query_id, id, score + 0.1 * len(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3 AND contains(lower(heading), w))) AS score FROM bm JOIN ch USING (id) JOIN qs USING (query_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hp",
    "ir_metrics": w(CHUNKS, POST, bm25(20)) + """,
ra AS (SELECT query_id, document_id AS doc, min(rank) AS r0 FROM bm JOIN ch USING (id) GROUP BY ALL),
rk AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM ra),
rl AS (SELECT query_id, doc_id AS doc, 1.0 AS gain FROM labels, qs WHERE quality = 1),
gt AS (SELECT query_id, count(*) FILTER (rank <= 10 AND gain > 0) AS hits, min(CASE WHEN gain > 0 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN coalesce(gain, 0) / log2(rank + 1) ELSE 0 END) AS dcg FROM rk LEFT JOIN rl USING (query_id, doc) GROUP BY ALL),
idl AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc) AS r FROM rl) GROUP BY ALL)
SELECT query_id, hits / 10 AS precision, hits / n AS recall, coalesce(1 / first, 0) AS mrr, dcg / idcg AS ndcg FROM gt LEFT JOIN idl USING (query_id)""",
    "exact_dedup": f"WITH k AS (SELECT doc_id, sha1({NORM.format('text')}) AS key FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first FROM k",
    "near_dup_pairs": f"""
WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP}))) AS ws FROM documents),
c AS (SELECT ws, min(doc_id) AS id FROM s WHERE len(ws) >= 4 GROUP BY ws),
p AS (SELECT x.id AS a, y.id AS b, x.ws AS wa, y.ws AS wb FROM c x JOIN c y ON x.id < y.id AND len(x.ws) >= 0.75 * len(y.ws) AND len(y.ws) >= 0.75 * len(x.ws)),
j AS (SELECT a, b, len(list_intersect(wa, wb)) AS i, len(wa) + len(wb) AS t FROM p)
SELECT a, b, i / (t - i) AS similarity FROM j WHERE i / (t - i) >= 0.75""",
    "token_f1": f"WITH p AS (SELECT item_id, {TOK.format('text')} AS a, {TOK.format('other')} AS b FROM (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark) WHERE other IS NOT NULL), c AS (SELECT item_id, len(a) + len(b) AS n, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS m, len(a) AS na, len(b) AS nb FROM p) SELECT item_id, CASE WHEN n = 0 THEN 1.0 ELSE 2.0 * m / n END AS f1 FROM c",
    "bleu1": f"WITH p AS (SELECT item_id, {TOK.format('text')} AS a, {TOK.format('other')} AS b FROM (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark) WHERE other IS NOT NULL), c AS (SELECT item_id, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS m, len(a) AS na, len(b) AS nb FROM p) SELECT item_id, CASE WHEN nb = 0 THEN 0.0 WHEN na = 0 THEN 1.0 ELSE (CASE WHEN nb < na THEN exp(1 - na / nb) ELSE 1.0 END) * m / nb END AS bleu FROM c",
    "exact_match": f"WITH p AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark) SELECT item_id, CAST({NORM.format('text')} = {NORM.format('other')} AS DOUBLE) AS same FROM p WHERE other IS NOT NULL",
    "groundedness": "WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS answer, max(text) AS evidence FROM conversations WHERE text IS NOT NULL GROUP BY conv_id), s AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(lower(answer), '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) > 4) AS ss, lower(evidence) AS e FROM t) SELECT conv_id, CASE WHEN len(ss) > 0 THEN len(list_filter(ss, lambda x: length(x) < 8 OR contains(e, x))) / len(ss) ELSE 0.0 END AS grounded FROM s",
    "evaluate_answers": "WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), h AS (SELECT *, list_contains(regexp_extract_all(lower(text), '([a-z][a-z0-9-]+)', 1), 'the')::INT AS p1, contains(lower(text), 'of the')::INT AS p2 FROM t), c AS (SELECT *, p1 * 2 + p2 AS g, (p1 + p2) / 2 AS part, NOT regexp_matches(text, '[A-Za-z0-9]') OR lower(trim(regexp_replace(text, '[.! ]+$', ''))) IN ('not attempted', 'no answer', 'blank', 'skipped', 'n/a', 'na', '-', 'none') AS blank, length(trim(text)) < 8 AS short, regexp_matches(text, '(^|[^0-9A-Za-z_])[0-9]{5,}($|[^0-9A-Za-z_])') OR length(text) - length(replace(text, '?', '')) > 2 AS flag FROM h), d AS (SELECT *, greatest(0.05, least(0.95, 0.9 - 0.5 * (1 - abs(2 * part - 1)) - CASE WHEN length(text) < 25 THEN 0.1 ELSE 0 END - CASE WHEN flag THEN 0.25 ELSE 0 END)) AS sure FROM c) SELECT conv_id, turn, CAST(CASE WHEN blank OR short THEN 0 ELSE least(g, 3) END AS BIGINT) AS awarded, CASE WHEN blank THEN 'blank' WHEN short THEN 'noCredit' WHEN g >= 3 THEN 'fullCredit' WHEN g > 0 THEN 'partialCredit' ELSE 'noCredit' END AS verdict, CASE WHEN blank THEN 1.0 WHEN short THEN 0.3 ELSE sure END AS confidence, CASE WHEN blank THEN false WHEN short THEN true ELSE sure < 0.75 OR flag END AS needs_review FROM d",
    "class_insights": w(ANSWERS) + ", p AS (SELECT assessment, concept, student, sum(awarded) / sum(max_marks) AS r FROM an GROUP BY ALL), o AS (SELECT assessment, count(DISTINCT student) AS roster FROM an GROUP BY ALL), c AS (SELECT assessment, concept, avg(r) AS accuracy, count(*) AS students, count(*) FILTER (r < 0.6) AS at_risk FROM p GROUP BY ALL) SELECT assessment, concept, round(accuracy, 9) AS accuracy, students, at_risk, round((1 - round(accuracy, 9)) * at_risk / roster, 9) AS priority, CAST(CASE WHEN round(accuracy, 9) < 0.3 THEN 45 WHEN round(accuracy, 9) < 0.45 THEN 30 WHEN round(accuracy, 9) < 0.6 THEN 20 ELSE 15 END AS BIGINT) AS minutes FROM c JOIN o USING (assessment)",
    "at_risk": w(ANSWERS) + " SELECT student, sum(awarded) / sum(max_marks) AS ratio, count(*) AS answers, count(DISTINCT concept) AS concepts FROM an GROUP BY student HAVING sum(awarded) / sum(max_marks) < 0.5",
    "shared_gaps": w(ANSWERS) + ", o AS (SELECT assessment, count(DISTINCT student) AS roster FROM an GROUP BY ALL), g AS (SELECT assessment, gap, count(DISTINCT student) AS students FROM an WHERE awarded < max_marks / 2 GROUP BY ALL HAVING count(DISTINCT student) > 1) SELECT assessment, gap, students, 100.0 * students / roster AS percent, rank FROM (SELECT *, row_number() OVER (PARTITION BY assessment ORDER BY students DESC, gap) AS rank FROM g JOIN o USING (assessment)) WHERE rank <= 10",
    "school_rollup": w(ANSWERS) + ", p AS (SELECT n_name AS school, student, concept, sum(awarded) / sum(max_marks) AS r FROM an JOIN customer ON student = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT school, count(*) AS students, avg(m) AS mean FROM (SELECT school, student, avg(r) AS m FROM p GROUP BY ALL) GROUP BY ALL), c AS (SELECT school, count(*) AS concepts, arg_min(concept, (round(r, 9), concept)) AS weakest FROM (SELECT school, concept, avg(r) AS r FROM p GROUP BY ALL) GROUP BY ALL) SELECT * FROM s JOIN c USING (school)",
    "sheet_totals": w(ANSWERS) + " SELECT assessment, student, sum(awarded) AS awarded, sum(max_marks) AS max_marks, count(*) FILTER (awarded < 0.1 * max_marks) AS review, 100 * sum(awarded) / sum(max_marks) AS percent FROM an GROUP BY ALL",
    "catalog": w(QUESTIONS) + " SELECT chapter, difficulty, count(*) AS questions, array_to_string(list_sort(list(DISTINCT marks)), ',') AS marks, avg(quality) AS quality FROM qu GROUP BY CUBE (chapter, difficulty)",
    "question_search": w(QUESTIONS) + " SELECT id, chapter, marks, quality FROM qu WHERE marks = 3 AND difficulty = 'medium' AND quality >= 0.5 ORDER BY quality DESC, id LIMIT 50",
    "practice_set": w(QUESTIONS, ANSWERS) + ", wk AS (SELECT student AS learner_id, concept AS chapter FROM an GROUP BY ALL HAVING sum(awarded) / sum(max_marks) < 0.1), f AS (SELECT chapter, id, row_number() OVER (PARTITION BY chapter ORDER BY CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, quality DESC, id) AS rank FROM qu) SELECT learner_id, chapter, id, rank FROM wk JOIN f USING (chapter) WHERE rank <= 3",
    "timetable": "WITH u AS (SELECT r_regionkey AS unit_no, 10 + 7 * r_regionkey AS marks FROM region), s AS (SELECT *, 96 * marks / sum(marks) OVER () AS raw FROM u), b AS (SELECT *, floor(raw) AS base FROM s), p AS (SELECT unit_no, marks, base + (row_number() OVER (ORDER BY round(raw - base, 9) DESC, unit_no) <= 96 - sum(base) OVER ())::INT AS periods FROM b), e AS (SELECT *, sum(periods) OVER (ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS stop FROM p) SELECT unit_no, marks, CAST(periods AS BIGINT) AS periods, CAST(floor((stop - periods) / 6) + 1 AS BIGINT) AS first_week, CAST(floor((stop - 1) / 6) + 1 AS BIGINT) AS last_week FROM e",
    "cooccurrence_pairs": w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2")) + " SELECT a, b, n FROM co",
    "entropy": w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2")) + " SELECT label, chunks, entropy FROM en",
    "prereq_votes": w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2")) + " SELECT * FROM vw",
    "upsert_latest": "WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders) SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, count(*) AS version FROM b GROUP BY o_custkey",
    "next_seq": w(EVENTS) + ", old AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-20 00:00:00'), new AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'), l AS (SELECT learner_id, max(seq) AS last FROM old GROUP BY ALL) SELECT new.learner_id, event_id, row_number() OVER (PARTITION BY new.learner_id ORDER BY t_us, event_id) + coalesce(last, 0) AS seq FROM new LEFT JOIN l USING (learner_id)",
    "ledger_dedupe": "WITH f AS (SELECT page_id, url, sha256(html) AS digest FROM pages) SELECT page_id, first_id, page_id <> first_id AS duplicate FROM (SELECT page_id, min(page_id) OVER (PARTITION BY digest) AS first_id FROM f)",
    "text_quality_flags": "SELECT doc_id, NOT (contains(text, '(A)') OR (contains(text, '(a)') AND contains(text, '(b)'))) AND regexp_matches(lower(text), '(is|are|following|respectively|option|options|correct|statement|statements) *[:-] *$') AS truncated, regexp_matches(text, '(^|[^0-9A-Za-z_])[0-9]{5,}($|[^0-9A-Za-z_])') AS fused, length(text) - length(replace(text, '?', '')) > 2 AS unresolved FROM documents WHERE text IS NOT NULL",
    "career_riasec": w(EVENTS) + """,
sj AS (SELECT *, CASE CAST(substr(concept_id, 2) AS INTEGER) % 3 WHEN 0 THEN 'math' WHEN 1 THEN 'language' END AS subject, CASE WHEN coalesce(duration_sec, 0) <= 0 THEN 1.0 ELSE greatest(1.0, duration_sec / 60) END AS x FROM ev),
rr AS (SELECT learner_id, sum(x * CASE subject WHEN 'math' THEN 0.2 WHEN 'language' THEN 0.0 ELSE 1/6 END) AS realistic, sum(x * CASE subject WHEN 'math' THEN 0.5 WHEN 'language' THEN 0.0 ELSE 1/6 END) AS investigative, sum(x * CASE subject WHEN 'math' THEN 0.0 WHEN 'language' THEN 0.3 ELSE 1/6 END) AS artistic,
  sum(x * CASE subject WHEN 'math' THEN 0.0 WHEN 'language' THEN 0.4 ELSE 1/6 END) AS social, sum(x * CASE subject WHEN 'math' THEN 0.0 WHEN 'language' THEN 0.0 ELSE 1/6 END) AS enterprising, sum(x * CASE subject WHEN 'math' THEN 0.3 WHEN 'language' THEN 0.3 ELSE 1/6 END) AS conventional FROM sj GROUP BY ALL),
tt AS (SELECT *, realistic + investigative + artistic + social + enterprising + conventional AS t FROM rr),
un AS (SELECT learner_id, unnest(['Realistic','Investigative','Artistic','Social','Enterprising','Conventional']) AS d, unnest([realistic / t, investigative / t, artistic / t, social / t, enterprising / t, conventional / t]) AS s FROM tt),
cd AS (SELECT learner_id, string_agg(substr(d, 1, 1), '' ORDER BY r) AS holland_code FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY round(s, 4) DESC, d) AS r FROM un) WHERE r <= 3 GROUP BY ALL)
SELECT learner_id, t AS evidence, realistic / t AS realistic, investigative / t AS investigative, artistic / t AS artistic, social / t AS social, enterprising / t AS enterprising, conventional / t AS conventional, holland_code FROM tt JOIN cd USING (learner_id)""",
    "reward_policy": w(EVENTS, MASTERY) + """,
rs AS (SELECT learner_id, concept_id, arg_max_null(affect, seq) AS last_affect, max_by(outcome, seq) FILTER (outcome IS NOT NULL) AS last_outcome FROM ev GROUP BY ALL),
rw AS (SELECT m.*, coalesce(last_affect = 'frustrated', false) AS fr, coalesce(last_outcome >= 0.4 AND last_outcome < 0.5, false) AS near FROM mastered m JOIN rs USING (learner_id, concept_id))
SELECT learner_id, concept_id, CASE WHEN attempts < 1 THEN 'none' WHEN fr OR near THEN 'encourage' WHEN mastery >= 0.85 THEN 'celebrate' WHEN round(0.6 * greatest(0.0, least(1.0, greatest(correct_runs / 3, attempts / 5))) + 0.4 * accuracy, 9) >= 0.8 AND correct_runs >= 1 THEN 'celebrate' WHEN accuracy < 0.2 THEN 'encourage' WHEN correct_runs >= 2 OR attempts >= 2 THEN 'acknowledge' ELSE 'none' END AS action
FROM (SELECT *, round(accuracy * attempts) AS correct_runs FROM rw)""",
    "bank_mapping": """WITH r AS (SELECT p_partkey AS id, 1 + p_partkey % 39 AS q, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS m, CASE WHEN p_size % 3 = 0 THEN 'analyze' ELSE 'understand' END AS bloom, p_brand AS chapter, p_size / 50 AS confidence FROM part),
k AS (SELECT *, CAST(CASE WHEN m >= 1 AND m < 11 THEN floor(m) WHEN q <= 20 THEN 1 WHEN q <= 26 THEN 2 WHEN q <= 33 THEN 3 WHEN q <= 36 THEN 5 ELSE 4 END AS BIGINT) AS marks FROM r),
b AS (SELECT *, CASE WHEN marks <= 2 THEN 0 WHEN marks = 3 THEN 1 ELSE 2 END + CASE bloom WHEN 'analyze' THEN 1 ELSE 0 END AS band FROM k)
SELECT id, chapter, marks, bloom, CASE WHEN band <= 0 THEN 'easy' WHEN band = 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN marks <= 1 THEN 'very_short_answer' WHEN marks = 2 THEN 'short_answer' WHEN marks <= 4 THEN 'long_answer' ELSE 'case_study' END AS type, greatest(1, marks * 2) AS minutes, round(0.6 + 0.3 * confidence, 2) AS quality FROM b""",
    "practice_outcome": w(EVENTS, MASTERY) + ", old AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-20 00:00:00')," + MASTERY.replace("FROM ev ", "FROM old ").replace("ms AS", "ms2 AS").replace("FROM ms)", "FROM ms2)").replace("mp AS", "mp2 AS").replace("FROM mp)", "FROM mp2)").replace("mastered AS", "mastered2 AS") + " SELECT a.learner_id, a.concept_id, coalesce(b.mastery, 0.0) AS before, a.mastery AS after, a.mastery - coalesce(b.mastery, 0.0) AS delta, CASE WHEN a.mastery >= 0.85 THEN 'advance' WHEN a.mastery > coalesce(b.mastery, 0.0) THEN 'continue' ELSE 'reteach' END AS action FROM mastered a LEFT JOIN mastered2 b USING (learner_id, concept_id)",
    "extraction_accuracy": "SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 <> 0 OR p_size IS NULL) AS right, count(*) FILTER (p_partkey % 7 <> 0 OR p_size IS NULL) / count(*) AS accuracy FROM part",
}

from scholia.plans import asked_oracle, folds_oracle, kept_oracle, stored_oracle, told_oracle, worked_oracle  # noqa: E402  they use the parts above

ORACLE_SQL |= stored_oracle.SQL | folds_oracle.SQL | worked_oracle.SQL | kept_oracle.SQL | told_oracle.SQL | asked_oracle.SQL
