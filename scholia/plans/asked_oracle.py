"""SQL of the queries in `asked`."""

from scholia.operators.answering import NEEDLESS, NOTHING
from scholia.plans import oracle, stored_oracle
from scholia.plans.asked import COMMON, PAPERS
from scholia.plans.oracle import CHUNKS, FOUND, LABELS, POST, TOK, bm25, tfidf, w

_STOP = "('the','a','an','of','in','for','on','what','how','why','is','are','to','and','or','explain','define','list','state','describe')"
_ASKED = "qs(query_id, query) AS (VALUES (1, 'the idiot of things'), (2, 'theory and nation src3'), (3, 'la tion des'), (4, 'version license public'))"


def _hybrid(limit: int, queries: str = _ASKED) -> str:
    assert _ASKED in POST
    return w(CHUNKS, POST.replace(_ASKED, queries), bm25(2 * limit), tfidf(2 * limit)) + f""",
ff AS (SELECT query_id, id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM ti) GROUP BY ALL),
kw AS (SELECT query_id, list_filter({TOK.format('query')}, lambda t: t NOT IN {_STOP})[1:5] AS keys FROM qs),
hy AS (SELECT query_id, id, score + 0.15 * len(list_filter(keys, lambda k: contains(lower(concat_ws(' ', heading, text)), k))) AS score FROM ff JOIN ch USING (id) JOIN kw USING (query_id)),
hi AS (SELECT h.query_id, h.rank, c.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hy) h JOIN ch c USING (id) WHERE rank <= {limit})"""


_EDGES = f"""
lb2(label) AS (VALUES {LABELS}),
pt AS (SELECT {TOK.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}[1] AS source, unnest(regexp_extract_all(html, '<a href=[^>]*>([^<]*)</a>', 1)) AS link FROM pages WHERE html IS NOT NULL),
pg AS (SELECT DISTINCT source, target FROM (SELECT source, {TOK.format('link')}[1] AS target FROM pt) WHERE source <> target AND source IN (SELECT label FROM lb2) AND target IN (SELECT label FROM lb2)),
tm AS (SELECT string_split(unnest(regexp_extract_all(lower(text), '([a-z]{{3,}} (requires|needs|uses|is|has) [a-z]{{3,}})', 1)), ' ') AS p FROM documents WHERE text IS NOT NULL),
te AS (SELECT p[1] AS source, p[3] AS target, bool_or(p[2] IN ('requires', 'needs', 'uses')) AS required FROM tm WHERE p[1] <> p[3] AND p[1] IN (SELECT label FROM lb2) AND p[3] IN (SELECT label FROM lb2) GROUP BY ALL)"""
_VOTES = stored_oracle.VOTES
for _old, _new in (
    ("ls AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT target AS id, 1 AS i, 0 AS o FROM le0 UNION ALL SELECT source, 0, 1 FROM le0)", "ls AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT target AS id, 1 AS i, 0 AS o FROM te UNION ALL SELECT source, 0, 1 FROM te)"),
    ("gr AS (SELECT label, min(6 + document_id % 5) AS grade FROM fo GROUP BY label)", "gr AS (SELECT label, min(length(bin(length(text)))) AS grade FROM fo JOIN documents ON doc_id = document_id GROUP BY label)"),
    ("FROM le0 WHERE source = y.label AND target = x.label) -", "FROM pg WHERE source = y.label AND target = x.label) -"),
    ("FROM le0 WHERE source = x.label AND target = y.label) AS hl", "FROM pg WHERE source = x.label AND target = y.label) AS hl"),
    # source requires target: the target is the prerequisite
    ("FROM le0 WHERE source = y.label AND target = x.label AND required)", "FROM te WHERE source = y.label AND target = x.label AND required)"),
    ("FROM le0 WHERE source = x.label AND target = y.label AND required)", "FROM te WHERE source = x.label AND target = y.label AND required)"),
):
    assert _old in _VOTES
    _VOTES = _VOTES.replace(_old, _new)

_COUNTED = ", ".join(f"{{'n': len(list_filter(ts, lambda t: t IN ({', '.join(repr(x) for x in listed)}))), 'lang': '{lang}'}}" for lang, listed in COMMON.items())
_CRITIC = _ASKED.replace("public'))", "public'), (5, 'what is the'), (6, 'zzyzx'))")
_SCHEMES = _ASKED.replace("(1, '", "(1, 'marking scheme ").replace("(2, '", "(2, 'marking scheme ").replace("(3, '", "(3, 'marking scheme ").replace("(4, '", "(4, 'marking scheme ")
_PAPERS = "qs(query_id, query) AS (VALUES " + ", ".join(f"({i}, 'question paper {x} marks')" for i, x in PAPERS) + ")"

SQL = {
    "doubt_answers": _hybrid(8) + f""",
pl AS (SELECT query_id, rank, document_id || ' p.' || page AS place, heading, substr(text, 1, 400) AS quote FROM hi),
an AS (SELECT query_id, string_agg('[' || rank || '] (' || place || ') ' || quote, chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 3) AS answer, string_agg(place || ' ' || heading, '; ' ORDER BY rank) AS citations, string_agg(place, '; ' ORDER BY rank) FILTER (rank <= 5) AS evidence, count(*) AS cited FROM pl GROUP BY query_id)
SELECT query_id, coalesce(answer, '{NOTHING}') AS answer, coalesce(citations, '') AS citations, coalesce(evidence, '') AS evidence, coalesce(cited, 0) AS cited FROM qs LEFT JOIN an USING (query_id)""",
    "critic_paths": _hybrid(6, _CRITIC) + f""",
kd AS (SELECT query_id, list_distinct(keys) AS keys FROM kw),
vd AS (SELECT hi.*, len(list_filter(keys, lambda k: list_contains({TOK.format('text')}, k))) AS n, len(keys) AS most FROM hi JOIN kd USING (query_id) WHERE rank <= 3),
sc AS (SELECT *, (n > 0)::INT + CASE WHEN most > 0 AND n = most THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END + 0.5 * (least(4, n) * 0.5 - 1.0) AS score FROM vd),
od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM sc),
ps AS (SELECT query_id, string_agg(document_id || ' p.' || page || ' ' || printf('%.3f', score), '; ' ORDER BY place) AS paths FROM od GROUP BY query_id),
oc AS (SELECT query_id, CASE WHEN len(keys) = 0 THEN 'needless' WHEN paths IS NULL THEN 'nothing' ELSE 'answered' END AS outcome, paths FROM kd LEFT JOIN ps USING (query_id))
SELECT oc.query_id, outcome, document_id, page, round(CAST(score AS DOUBLE), 3) AS score, CASE WHEN outcome = 'answered' THEN paths ELSE '' END AS paths,
  CASE outcome WHEN 'needless' THEN '{NEEDLESS}' WHEN 'nothing' THEN '{NOTHING}' ELSE '[' || document_id || ' p.' || page || '] ' || substr(text, 1, 500) END AS answer
FROM oc LEFT JOIN od ON od.query_id = oc.query_id AND place = 1 AND outcome = 'answered'""",
    "scheme_citations": _hybrid(8, _SCHEMES) + """,
nm2 AS (SELECT *, contains(lower(document_id || ' ' || heading), 'src1') AS named FROM hi),
ay AS (SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS any_ FROM nm2),
ky AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, document_id, page, heading FROM ay WHERE named OR NOT any_)
SELECT * FROM ky WHERE rank <= 5""",
    "paper_sections": _hybrid(10, _PAPERS) + """,
se AS (SELECT query_id, heading, min(rank) AS first, count(*) AS hits, string_agg(substr(text, 1, 120), ' | ' ORDER BY rank) AS texts FROM hi WHERE heading <> '' GROUP BY ALL)
SELECT query_id, heading, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place, hits, texts FROM se""",
    "grade_prereqs": w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2")) + """,
gd AS (SELECT DISTINCT label, length(bin(length(text))) AS grade FROM fo JOIN documents ON doc_id = document_id WHERE text IS NOT NULL),
gm AS (SELECT label, min(grade) AS first FROM gd GROUP BY label)
SELECT x.label AS prerequisite, y.label AS concept, (SELECT count(*) FROM gd a JOIN gd b ON a.grade < b.grade WHERE a.label = x.label AND b.label = y.label) AS n FROM gm x JOIN gm y ON x.first < y.first""",
    "page_links": "WITH " + _EDGES + " SELECT source, target FROM pg",
    "prereq_votes_mined": oracle.w(CHUNKS, _EDGES, _VOTES),
    "language_accuracy": f"WITH t AS (SELECT doc_id, lang, {TOK.format("coalesce(text, '')")} AS ts FROM documents), b AS (SELECT doc_id, lang, list_max([{_COUNTED}]) AS best FROM t), p AS (SELECT doc_id, lang, CASE WHEN best.n > 0 THEN best.lang END AS predicted FROM b) SELECT count(*) AS n, count(DISTINCT doc_id) FILTER (lang IS NOT DISTINCT FROM predicted) AS right, count(DISTINCT doc_id) FILTER (lang IS NOT DISTINCT FROM predicted) / count(*) AS accuracy FROM p",
    "paper_requests": """
WITH cu AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS title, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS subject, c_nationkey AS grade, ['draft', 'approved', 'review', NULL][c_custkey % 4 + 1] AS status FROM customer WHERE c_custkey % 5 <> 0),
qn AS (SELECT l_orderkey AS paper_id, l_linenumber AS position, p_brand AS subject, p_size AS grade, 1 + p_size % 5 AS marks FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30),
qc AS (SELECT paper_id, count(*) AS questions, CAST(sum(marks) AS BIGINT) AS marks FROM qn GROUP BY paper_id),
qf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY position, subject, grade) AS r FROM qn) WHERE r = 1),
jn AS (SELECT o_orderkey AS paper_id, CASE WHEN questions IS NULL THEN 'empty' WHEN cu.status = 'approved' THEN 'locked' ELSE 'generated' END AS outcome, title, coalesce(cu.subject, qf.subject) AS subject, CAST(coalesce(cu.grade, qf.grade) AS BIGINT) AS grade, coalesce(questions, 0) AS questions, coalesce(qc.marks, 0) AS marks, cu.status, cu.id
  FROM orders LEFT JOIN qc ON qc.paper_id = o_orderkey LEFT JOIN qf ON qf.paper_id = o_orderkey LEFT JOIN cu ON cu.id = o_custkey)
SELECT paper_id, outcome, CASE WHEN outcome = 'generated' THEN coalesce(title, 'Assessment') END AS title, CASE WHEN outcome = 'generated' THEN subject END AS subject, CASE WHEN outcome = 'generated' THEN grade END AS grade, questions, marks,
  CASE WHEN outcome <> 'generated' THEN status WHEN id IS NOT NULL THEN 'paperGenerated' END AS status FROM jn""",
}
