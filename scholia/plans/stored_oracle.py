"""DuckDB SQL of the queries in `stored`."""

from __future__ import annotations

from scholia.plans.oracle import ANSWERS, CHUNKS, EDGES, EVENTS, FORWARD, FOUND, LABELS, MASTERY, POST, bm25, tfidf, w

NODES = """
nd AS (SELECT 'p' || p_partkey AS id, ['CONCEPT', 'QUESTION_PAPER', 'ANSWER_SCHEME', 'ASSESSMENT_BLUEPRINT'][p_partkey % 4 + 1] AS type, p_name AS label, CASE WHEN p_size % 2 = 0 THEN 'draft' ELSE 'active' END AS status, CASE WHEN p_size % 3 > 0 THEN '20' || (20 + p_size % 5) END AS academic_year FROM part)"""
TYPED = """
te AS (SELECT 'p' || l_partkey || '-s' || l_suppkey AS edge, 'p' || l_partkey AS source, 's' || l_suppkey AS target, ['PREREQUISITE_OF', 'RELATED_TO', 'SUPPORTED_BY'][(l_partkey + l_suppkey) % 3 + 1] AS type FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)),
bo AS (SELECT edge, type, source AS f, target AS t FROM te UNION ALL SELECT edge, type, target, source FROM te)"""


def levels(start: str, depth: int) -> str:
    """CTEs r0 .. r<depth>: start, id, depth, edge, type of the nodes met first at that depth; `start` selects (start, id)."""
    out = [f"r0 AS (SELECT start, id, 0 AS depth, NULL AS edge, NULL AS type FROM ({start}))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT start, id FROM r{k}" for k in range(d))
        out.append(f"r{d} AS (SELECT r.start, b.t AS id, {d} AS depth, min(b.edge) AS edge, arg_min(b.type, b.edge) AS type FROM r{d - 1} r JOIN bo b ON b.f = r.id WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.start = r.start AND s.id = b.t) GROUP BY ALL)")
    return ", ".join(out)


def union(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT start, id, depth, edge, type FROM r{k}" for k in range(1, depth + 1))


CONCEPTS = """
ce AS (SELECT source, target, ['PREREQUISITE_OF', 'RELATED_TO', 'SUPPORTED_BY'][(a + b) % 3 + 1] AS type, [['Requires'], ['is', 'needs'], ['has'], NULL][(a * 3 + b) % 4 + 1] AS predicates, CASE WHEN a * b % 5 = 0 THEN 'it depends on that' END AS span
  FROM (SELECT source, target, CAST(substr(source, 2) AS INTEGER) AS a, CAST(substr(target, 2) AS INTEGER) AS b FROM fw))"""
BLOCKS = """
bl AS (SELECT conv_id AS document_id, CAST(1 + turn // 4 AS BIGINT) AS page, CAST(turn AS BIGINT) AS place, trim(CASE turn % 3 WHEN 0 THEN (turn + 1) || '. ' || text || ' (' || (1 + turn % 4) || ' marks)' WHEN 1 THEN '(' || ['a', 'b', 'c', 'd', 'e'][turn % 5 + 1] || ') ' || text ELSE text END) AS text FROM conversations WHERE text IS NOT NULL),
bq AS (SELECT *, CASE WHEN regexp_matches(text, '^[ \\t]*([0-9]{1,3})[ \\t]*[.)\\]]') THEN regexp_extract(text, '^[ \\t]*([0-9]{1,3})[ \\t]*[.)\\]]', 1) END AS q_no, regexp_matches(text, '^[ \\t]*\\(([a-z])\\)') AS is_part,
  CASE WHEN regexp_matches(text, '(?i)\\([ \\t]*([0-9]+([.][0-9]+)?)[ \\t]*(marks?)?[ \\t]*\\)') THEN CAST(regexp_extract(text, '(?i)\\([ \\t]*([0-9]+([.][0-9]+)?)[ \\t]*(marks?)?[ \\t]*\\)', 1) AS DOUBLE) END AS marks FROM bl WHERE text <> ''),
bn AS (SELECT *, count(q_no) OVER (PARTITION BY document_id ORDER BY page, place ROWS UNBOUNDED PRECEDING) AS number FROM bq)"""


def typed(text: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains(lower({text}), '{x}')" for x in words) + ")"
    return f"CASE WHEN {has('multiple choice', 'mcq', 'choose')} THEN 'mcq' WHEN {has('case study', 'passage')} THEN 'case_study' WHEN {has('long', 'essay')} THEN 'long_answer' WHEN {has('short')} THEN 'short_answer' ELSE 'unknown' END"


def bloomed(text: str) -> str:
    words = "remember remember recall remember understand understand explain understand apply apply calculate apply analyze analyze compare analyze evaluate evaluate justify evaluate create create design create".split()
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{a}') THEN '{b}'" for a, b in zip(words[::2], words[1::2], strict=True)) + " END"


QUESTIONED = f"""
qs1 AS (SELECT document_id, number, max(q_no) AS q_no, max(text) FILTER (q_no IS NOT NULL) AS first, string_agg(text, ' ' ORDER BY page, place) FILTER (NOT (q_no IS NULL AND is_part)) AS said, count(*) FILTER (q_no IS NULL AND is_part) AS parts, max(marks) FILTER (q_no IS NOT NULL) AS marks FROM bn WHERE number > 0 GROUP BY ALL),
qs2 AS (SELECT document_id, number, q_no, marks, {typed('first')} AS type, {bloomed('first')} AS bloom, substr(first, 1, 120) AS title, said AS text, parts FROM qs1),
pt AS (SELECT b.document_id, b.number, q.q_no, regexp_extract(b.text, '^[ \\t]*\\(([a-z])\\)', 1) AS part, b.text FROM bn b JOIN qs1 q USING (document_id, number) WHERE b.q_no IS NULL AND b.is_part AND b.number > 0)"""
GENERIC = "process processes way ways thing things part parts whole example examples result results kind kinds type types number numbers amount amounts case cases side sides point points group groups set sets form forms method methods step steps value values unit units place places time times year years"
STOPPED = "the a an of in is are to and or for on at it its this that which with from by as be following i ii iii iv v vi vii viii ix x cm mm km kg g mg ml l m s h min hrs sq"
VOTES = (
    FOUND.replace("WT", "1").replace("WB", "2")
    + f""",
nm0 AS (SELECT label, row_number() OVER () - 1 AS i FROM (VALUES {LABELS}) v(label)),
le0 AS (SELECT x.label AS source, y.label AS target, (x.i + y.i) % 3 = 0 AS required FROM nm0 x, nm0 y WHERE x.i <> y.i AND (7 * x.i + 3 * y.i) % 4 = 0),
ls AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT target AS id, 1 AS i, 0 AS o FROM le0 UNION ALL SELECT source, 0, 1 FROM le0) GROUP BY id),
gr AS (SELECT label, min(6 + document_id % 5) AS grade FROM fo GROUP BY label),
al AS (SELECT DISTINCT label FROM fo),
pr AS (SELECT x.label AS a, y.label AS b, coalesce((SELECT n FROM co WHERE co.a = x.label AND co.b = y.label), 0) AS n,
    (SELECT count(*) FROM le0 WHERE source = y.label AND target = x.label) - (SELECT count(*) FROM le0 WHERE source = x.label AND target = y.label) AS hl,
    (SELECT count(*) FROM le0 WHERE source = y.label AND target = x.label AND required) - (SELECT count(*) FROM le0 WHERE source = x.label AND target = y.label AND required) AS tx
  FROM al x JOIN al y ON x.label < y.label),
vv AS (SELECT pr.a, pr.b, hl, tx, coalesce(sign(ahead - behind), 0) AS t, CASE WHEN x.entropy - y.entropy > 1e-9 THEN 1 WHEN x.entropy - y.entropy < -1e-9 THEN -1 ELSE 0 END AS e,
    coalesce(sign((lx.i + 1) / (lx.i + lx.o + 1) - (ly.i + 1) / (ly.i + ly.o + 1)), 0) AS l, sign(gy.grade - gx.grade) AS c
  FROM pr LEFT JOIN ov USING (a, b) JOIN en x ON x.label = pr.a JOIN en y ON y.label = pr.b LEFT JOIN ls lx ON lx.id = pr.a LEFT JOIN ls ly ON ly.id = pr.b JOIN gr gx ON gx.label = pr.a JOIN gr gy ON gy.label = pr.b WHERE n >= 2 OR hl <> 0),
va0 AS (SELECT *, (t > 0)::INT + 3 * (c > 0)::INT + 3 * (l > 0)::INT + 2 * (e > 0)::INT + 2 * (tx > 0)::INT + 3 * (hl > 0)::INT AS va, (t < 0)::INT + 3 * (c < 0)::INT + 3 * (l < 0)::INT + 2 * (e < 0)::INT + 2 * (tx < 0)::INT + 3 * (hl < 0)::INT AS vb,
    greatest(c, l, tx, hl) AS most, least(c, l, tx, hl) AS least0 FROM vv WHERE abs(t) + abs(c) + abs(l) + abs(e) + abs(tx) + abs(hl) >= 2)
SELECT CASE WHEN va > vb THEN a ELSE b END AS prerequisite, CASE WHEN va > vb THEN b ELSE a END AS concept, abs(va - vb) / (va + vb) AS score, CAST(greatest(va, vb) AS BIGINT) AS weight, CAST(least(va, vb) AS BIGINT) AS against
FROM va0 WHERE abs(va - vb) / (va + vb) >= 0.28 AND CASE WHEN va > vb THEN most > 0 ELSE least0 < 0 END"""
)

SQL: dict[str, str] = {
    "event_range": w(EVENTS) + " SELECT learner_id, seq, event_id, kind FROM ev WHERE learner_id = 7 AND seq > 5",
    "node_scan": w(NODES) + " SELECT id, label FROM nd WHERE status = 'draft' AND type = 'CONCEPT' AND lower(label) LIKE '%re%'",
    "ledger_scan": "SELECT o_orderkey AS source_id, o_orderstatus AS status, o_orderdate AS registered_at FROM orders WHERE o_orderstatus = 'P'",
    "ledger_register": "SELECT o_orderkey AS source_id, o_orderstatus AS status FROM orders UNION ALL SELECT DISTINCT l_orderkey + l_partkey % 3, 'new' FROM lineitem WHERE l_orderkey + l_partkey % 3 NOT IN (SELECT o_orderkey FROM orders)",
    "table_select": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
    "table_update": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name, s_nationkey FROM supplier WHERE s_nationkey <> 5",
    "newest_assessments": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'",
    "graded_sheets": w(ANSWERS) + " SELECT count(*) AS sheets, count(DISTINCT assessment) AS assessments, count(DISTINCT student) AS students FROM an",
    "school_templates": """SELECT n_nationkey AS school, coalesce(CASE WHEN n_nationkey % 4 = 0 AND n_nationkey * 3 IN (SELECT s_suppkey FROM supplier) THEN 't' || (n_nationkey * 3) END,
  (SELECT max('t' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 5 = 0), 'builtin') AS template FROM nation""",
    "graph_snapshot": w(EVENTS, EDGES) + " SELECT 'snap:' || ((SELECT count(*) FROM region) + 1) AS snapshot_id, CASE WHEN (SELECT count(*) FROM region) > 0 THEN 'snap:' || (SELECT count(*) FROM region) END AS parent_snapshot_id, (SELECT count(*) FROM part) AS node_count, (SELECT count(*) FROM ed) AS edge_count, 'nightly' AS notes",
    "index_replace": w(CHUNKS) + " SELECT id, document_id, CASE WHEN document_id % 10 = 0 THEN 'new ' || text ELSE text END AS text FROM ch WHERE document_id % 10 <> 0 OR page = 1",
    "audit_append": "SELECT substr(sha256(o_orderdate || '|graded|' || o_orderkey || '|' || o_custkey || '||' || coalesce(o_orderpriority, '')), 1, 16) AS id, o_orderdate AS at, 'graded' AS action, CAST(o_orderkey AS VARCHAR) AS assessment FROM orders",
    "answer_key_put": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1",
    "answer_key_stats": "SELECT count(*) AS keys, count(*) FILTER (p_size % 2 = 0) AS objective, count(*) FILTER (p_size % 3 = 0 AND p_name <> '') AS written, count(DISTINCT p_brand) AS papers FROM part",
    "corpus_stats": "SELECT coalesce(source, 'unknown') AS kind, count(*) AS sources, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters FROM documents GROUP BY ALL",
    "question_blocks": w(BLOCKS, QUESTIONED) + " SELECT * FROM qs2",
    "question_parts": w(BLOCKS, QUESTIONED) + " SELECT * FROM pt",
    "page_layout": w(BLOCKS) + """, lb AS (SELECT document_id, page, place, trim(CASE place % 7 WHEN 5 THEN 'Section: ' || place WHEN 6 THEN 'a) ' || text WHEN 4 THEN place || '. ' || substr(text, 1, 60) ELSE text END) AS text, (8 + (document_id + 3 * place) % 7)::DOUBLE AS size FROM bl),
lm AS (SELECT *, regexp_matches(text, '^[ \\t]*([0-9]{1,3})[.|\\-) \\t][ \\t]') AS num, regexp_matches(text, '(?i)\\([ \\t]*[0-9]+[ \\t]*(marks?|×[ \\t]*[0-9]+)?[ \\t]*\\)') AS mk, max(size) OVER (PARTITION BY document_id, page) AS most FROM lb),
lu AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^[ \\t]*(unit|chapter|lesson|module|section|topic|part)[ .\\-:\\t]*[0-9IVX]+') OR (size >= 0.85 * most AND length(text) < 140) THEN 'heading' WHEN num AND mk THEN 'question' END AS upper FROM lm),
lk AS (SELECT *, coalesce(lag(upper IS NOT NULL) OVER (PARTITION BY document_id, page ORDER BY place), false) AS behind FROM lu)
SELECT document_id, place, coalesce(upper, CASE WHEN num AND NOT behind AND length(text) < 160 OR regexp_matches(text, '^[ \\t]*([a-z][.)\\-])[ \\t]') AND length(text) < 200 THEN 'list' ELSE 'paragraph' END) AS kind FROM lk""",
    "marking_points": w(BLOCKS) + " SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page, place) AS point, marks, substr(text, 1, 400) AS detail FROM bq WHERE marks IS NOT NULL",
    "paper_blueprints": "SELECT doc_id AS document_id, 1 AS page FROM documents WHERE contains(lower(text), 'design of question paper') OR doc_id % 7 = 0 AND text IS NOT NULL OR contains(lower(text), 'blueprint') AND contains(lower(text), 'marks')",
    "question_types": f"SELECT doc_id, {typed('text')} AS type, {bloomed('text')} AS bloom FROM documents WHERE text IS NOT NULL",
    "concept_labels": f"""WITH l AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]+')) AS label FROM documents WHERE text IS NOT NULL), t AS (SELECT label, trim(lower(label)) AS low FROM l)
SELECT label, length(low) BETWEEN 2 AND 60 AND regexp_matches(low, '[a-z]') AND NOT list_contains(string_split('{GENERIC} {STOPPED}', ' '), low) AND NOT regexp_matches(low, '^(q[.]|ans|answer |fig |figure |exercise|chapter|section)') AS meaningful FROM t""",
    "scorable_questions": "SELECT p_partkey AS id, p_partkey IN (SELECT s_suppkey FROM supplier) OR p_size % 7 = 0 OR NOT (p_size % 3 = 0 OR p_size % 5 = 0) AS scorable FROM part",
    "merged_answer_keys": "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'option C' WHEN p_size % 3 > 0 THEN p_brand || ';' || p_type ELSE '' END AS points, CASE WHEN p_size % 4 = 0 THEN 'C' END AS option FROM part",
    "progress_actions": w(EVENTS, MASTERY) + " SELECT learner_id, concept_id, CASE WHEN CAST(substr(concept_id, 2) AS INTEGER) % 9 = 0 THEN 'misconception:motion' WHEN attempts < 3 THEN 'more_evidence' WHEN accuracy < mastery THEN 'unsteady' ELSE 'reteach' END AS action FROM mastered",
    "progress_summary": w(EVENTS, MASTERY) + " SELECT learner_id, count(*) AS concepts, count(*) FILTER (mastery >= 0.85) AS strong, count(*) FILTER (mastery < 0.55) AS weak, avg(mastery) AS mastery, CAST(sum(attempts) AS BIGINT) AS evidence FROM mastered GROUP BY ALL",
    "critic_scores": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE (p_size % 2 = 0)::INT + [1.0, 0.5, 0.0][p_size % 3 + 1] + 0.5 * CASE WHEN p_size % 6 BETWEEN 1 AND 5 THEN (p_size % 6 - 3) / 2 ELSE 0 END END::DOUBLE AS score FROM part",
    "scheme_evidence": "WITH t AS (SELECT conv_id AS query_id, turn AS id, contains(lower(text), 'the') AS m FROM conversations WHERE text IS NOT NULL), s AS (SELECT query_id, bool_or(m) AS any_m FROM t GROUP BY ALL) SELECT query_id, id FROM t JOIN s USING (query_id) WHERE m OR NOT any_m",
    "concept_chain": w(TYPED, levels("SELECT 'p1' AS start, 'p1' AS id", 2)) + f" SELECT start, id, CAST(depth AS BIGINT) AS depth, CASE WHEN type = 'PREREQUISITE_OF' THEN 'prerequisite' ELSE 'related' END AS part FROM ({union(2)})",
    "evidence_chain": w(TYPED, levels("SELECT 'p2' AS start, 'p2' AS id", 3)) + f" SELECT start, id, CAST(depth AS BIGINT) AS depth, edge, type FROM ({union(3)})",
    "exam_pattern": w(NODES) + " SELECT id, type FROM nd WHERE type <> 'CONCEPT' AND contains(lower(label), 'a') AND (academic_year IS NULL OR contains(academic_year, '202'))",
    "reasoning_paths": w(EVENTS, EDGES, FORWARD, CONCEPTS) + ", r(path, types, cur, hops) AS (SELECT source || '>' || target, type, target, 1 FROM ce WHERE source = 'c0' UNION ALL SELECT path || '>' || target, types || '>' || type, target, hops + 1 FROM r JOIN ce ON r.cur = ce.source WHERE hops < 3 AND cur <> 'c19') SELECT path, types FROM r WHERE cur = 'c19'",
    "query_subgraph": w(
        NODES,
        TYPED,
        """
aq AS (SELECT p_partkey AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name), '([a-z0-9]+)', 1), lambda t: t NOT IN ('the','a','an','of','in','for','on','what','how','why','is','are','to','and','or','explain','define','list','state','describe'))[1:3])) AS word FROM part WHERE p_partkey % 50 = 0),
aw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(label), '([a-z0-9]+)', 1)) AS word FROM nd WHERE type = 'CONCEPT'),
an0 AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, word ORDER BY id) AS r FROM aq JOIN aw USING (word)) WHERE r <= 3)""",
        levels("SELECT DISTINCT id AS start, id FROM an0", 2),
    )
    + f" SELECT query_id, u.id, CAST(min(depth) AS BIGINT) AS depth FROM an0 JOIN ({union(2)}) u ON u.start = an0.id GROUP BY query_id, u.id",
    "object_graph": w(BLOCKS, QUESTIONED) + """ SELECT 'QUESTION_PAPER' AS type, count(DISTINCT document_id) AS n FROM qs2 UNION ALL SELECT 'QUESTION', count(*) FROM qs2 UNION ALL SELECT 'QUESTION_PART', (SELECT count(*) FROM (SELECT DISTINCT document_id, number, part FROM pt))
UNION ALL SELECT 'CONTAINS', (SELECT count(*) FROM qs2) + (SELECT count(*) FROM (SELECT DISTINCT document_id, number, part FROM pt))""",
    "hybrid_graph_search": w(CHUNKS, POST, bm25(24), tfidf(24)) + """,
ff AS (SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM ti) GROUP BY ALL),
kw AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '([a-z0-9]+)', 1), lambda t: t NOT IN ('the','a','an','of','in','for','on','what','how','why','is','are','to','and','or','explain','define','list','state','describe'))[1:5] AS keys FROM qs),
h1 AS (SELECT query_id, ff.id, ff.score + 0.15 * len(list_filter(keys, lambda k: contains(lower(concat_ws(' ', heading, text)), k))) + CASE WHEN ch.document_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.1 ELSE 0.0 END
    + CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY round(ff.score, 9) DESC, ff.id) <= 12 THEN CASE query_id WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.0 END ELSE 0.0 END AS score FROM ff JOIN ch ON ch.id = ff.id JOIN kw USING (query_id))
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM h1) WHERE rank <= 12""",
    "prereq_votes_all": w(CHUNKS, VOTES),
    "link_stats": w(EVENTS, EDGES, FORWARD, CONCEPTS) + ", u AS (SELECT * FROM ce WHERE type = 'RELATED_TO' AND (list_contains(predicates, 'Requires') OR list_contains(predicates, 'needs'))) SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT target AS id, 1 AS i, 0 AS o FROM u UNION ALL SELECT source, 0, 1 FROM u) GROUP BY id",
    "text_prereqs": w(EVENTS, EDGES, FORWARD, CONCEPTS) + " SELECT DISTINCT source AS concept, target AS prerequisite FROM ce WHERE type = 'RELATED_TO' AND (coalesce(list_contains(predicates, 'Requires') OR list_contains(predicates, 'needs'), false) OR span IS NOT NULL)",
    "concept_profile": w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2")) + """,
ct AS (SELECT concept, prerequisite, max(score) AS score FROM (SELECT concept, prerequisite, score FROM vw UNION ALL SELECT x.concept, y.prerequisite, x.score * y.score FROM vw x JOIN vw y ON x.prerequisite = y.concept WHERE x.concept <> y.prerequisite AND x.score * y.score >= 0.28) GROUP BY ALL),
pf AS (SELECT label, count(*) AS chunks, count(DISTINCT document_id) AS documents, (SELECT count(*) FROM vw WHERE concept = label) AS prerequisites, (SELECT count(*) FROM ct WHERE concept = label) AS closure FROM fo GROUP BY label),
pd AS (SELECT *, greatest(1.0, least(5.0, round_even(2.0 + CASE WHEN chunks < 3 THEN 1.0 WHEN chunks < 8 THEN 0.5 ELSE 0.0 END - CASE WHEN documents >= 3 THEN 0.5 ELSE 0.0 END + CASE WHEN prerequisites >= 8 THEN 1.0 WHEN prerequisites >= 4 THEN 0.5 ELSE 0.0 END, 0))) AS difficulty FROM pf)
SELECT label, chunks, documents, prerequisites, closure, CAST(difficulty AS DOUBLE) AS difficulty, CAST(0.5 * difficulty + 0.5 AS DOUBLE) AS hours FROM pd""",
}
