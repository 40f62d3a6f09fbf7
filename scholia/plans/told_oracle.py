"""SQL of the queries in `told`."""

from scholia.operators.curriculum import BLOOM_VERBS
from scholia.operators.outcomes import JUNK, NO_PREREQUISITE, STATEMENTS
from scholia.plans import oracle, stored_oracle

_LEVELS = list(BLOOM_VERBS)
_FIRST = {v: _LEVELS.index(level) for level in reversed(_LEVELS) for v in BLOOM_VERBS[level]}
_VERBS = ("define", "explain", "solve", "compare", "examine", "justify", "design", "support", "state", "imagine", "discuss")
_ODD = ("school", "life", "size", "page")


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CHUNKS = oracle.CHUNKS + f""",
ch1 AS (SELECT * REPLACE (concat_ws(' ', text, [{_listed(_VERBS)}][document_id % {len(_VERBS)} + 1], [{_listed(_ODD)}][document_id % {len(_ODD)} + 1]) AS text) FROM ch)"""
_LABELS = ", ".join([oracle.LABELS, *(f"('{x}')" for x in _ODD)])
_FOUND = oracle.FOUND.replace("WT", "1").replace("WB", "2").replace("FROM ch)", "FROM ch1)")
_FOUND = _FOUND.replace(f"(VALUES {oracle.LABELS})", f"(SELECT label FROM (VALUES {_LABELS}) x(label) WHERE label NOT IN ({_listed(JUNK)}))")
_FOUND = _FOUND.rsplit("vw AS (", 1)[0] + "vw0 AS (" + _FOUND.rsplit("vw AS (", 1)[1] + f", vw AS (SELECT * FROM vw0 WHERE prerequisite NOT IN ({_listed(NO_PREREQUISITE)}))"
_PROFILES = oracle.w(_CHUNKS, _FOUND) + f""",
vb AS (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS v FROM ch1),
lv AS (SELECT label, CASE v {" ".join(f"WHEN '{v}' THEN {i}" for v, i in _FIRST.items())} END AS l FROM fo JOIN vb USING (id)),
ln2 AS (SELECT label, l, count(*) AS n FROM lv WHERE l IS NOT NULL GROUP BY ALL),
bl AS (SELECT label, [{_listed(_LEVELS)}][max_by(l, (n, l)) + 1] AS bloom FROM ln2 GROUP BY label),
by_ AS (SELECT label, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM fo GROUP BY label),
np AS (SELECT concept AS label, count(*) AS prerequisites FROM vw GROUP BY ALL),
jo AS (SELECT label, chunks, documents, coalesce(prerequisites, 0) AS prerequisites, coalesce(bloom, 'understand') AS bloom FROM by_ LEFT JOIN np USING (label) LEFT JOIN bl USING (label)),
df AS (SELECT *, greatest(1.0, least(5.0, round_even(CASE bloom WHEN 'remember' THEN 1.0 WHEN 'analyze' THEN 3.0 WHEN 'evaluate' THEN 4.0 WHEN 'create' THEN 4.0 ELSE 2.0 END
  + CASE WHEN chunks < 3 THEN 1.0 WHEN chunks < 8 THEN 0.5 ELSE 0.0 END - CASE WHEN documents >= 3 THEN 0.5 ELSE 0.0 END + CASE WHEN prerequisites >= 8 THEN 1.0 WHEN prerequisites >= 4 THEN 0.5 ELSE 0.0 END, 0))) AS difficulty FROM jo),
pr AS (SELECT *, 0.5 * difficulty + 0.5 AS hours, 'lo:' || substr(sha1(bloom || ':' || label), 1, 16) AS outcome_id,
  CASE bloom {" ".join(f"WHEN '{level}' THEN replace('{said}', '%s', label)" for level, said in STATEMENTS.items())} END AS statement FROM df)"""

_BELOW = "translate(CAST({} AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉')"
_ABOVE = "translate(CAST({} AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')"
_SIGNS = {"1 2": "½", "1 3": "⅓", "2 3": "⅔", "1 4": "¼", "3 4": "¾", "1 5": "⅕", "2 5": "⅖", "3 5": "⅗", "1 6": "⅙"}
_FRACTION = "CASE a || ' ' || b " + " ".join(f"WHEN '{pair}' THEN '{sign}'" for pair, sign in _SIGNS.items()) + " ELSE a || '/' || b END"

def _hybrid() -> str:
    """The plain hybrid search, with what the anchors give in place of numbers."""
    met = oracle.FOUND.split(",\nfp AS")[0].strip()
    anchors = f"""{met},
nb AS (SELECT DISTINCT a AS label FROM co WHERE n >= 2),
kq AS (SELECT query_id, unnest((list_filter(regexp_extract_all(lower(query), '([a-z0-9]+)', 1), lambda t: t NOT IN ('the','a','an','of','in','for','on','what','how','why','is','are','to','and','or','explain','define','list','state','describe')))[1:3]) AS label FROM qs),
an AS (SELECT query_id, least(0.2, 0.05 * count(DISTINCT label)) AS extra FROM kq JOIN lb USING (label) JOIN nb USING (label) GROUP BY query_id),
ff AS ("""
    extra = "coalesce((SELECT extra FROM an WHERE an.query_id = ff.query_id), 0.0)"
    return stored_oracle.SQL["hybrid_graph_search"].replace("ff AS (", anchors, 1).replace("CASE query_id WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 ELSE 0.0 END", extra, 1)


SQL = {
    "restored_notation": f"""
WITH x AS (SELECT p_partkey, 2 + p_size % 7 AS n, 1 + p_size % 3 AS a, 2 + p_size % 3 + p_partkey % 4 AS b, ['cm', 'kg', 's'][p_partkey % 3 + 1] AS unit FROM part)
SELECT p_partkey, 'C' || {_BELOW.format('n')} || 'H' || {_BELOW.format('n + 1')} || 'OH  ⇌  H' || {_BELOW.format('n')} || 'SO₄ in a reaction of Fe' || {_ABOVE.format('n')} || '⁺, 3 × 10' || {_ABOVE.format('n')} || ' m/s, '
  || n || ' ' || unit || '², the ratio of glass is ' || {_FRACTION} || '.' AS text FROM x""",
    "page_blocks": """
WITH x AS (SELECT l_orderkey AS page, l_orderkey % 3 AS kind_of, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n, l_partkey FROM lineitem),
lone AS (SELECT page, count(*) AS size, count(*) FILTER (n % 2 = 1) AS right_lines, count(*) FILTER (n > 0) AS more FROM x GROUP BY page),
b AS (
  SELECT page, n % 2 AS block, n AS line, 't' || l_partkey AS text, chr(10) AS joint, 'paragraph' AS kind FROM x WHERE kind_of = 0
  UNION ALL SELECT page, n // 3, n, 't' || l_partkey, CASE WHEN more > 0 THEN ' | ' ELSE chr(10) END, CASE WHEN more > 0 THEN 'row' ELSE 'paragraph' END FROM x JOIN lone USING (page) WHERE kind_of = 1
  UNION ALL SELECT page, CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END, n, CASE WHEN n > 0 THEN 'line ' ELSE 't' END || l_partkey, chr(10), 'paragraph' FROM x WHERE kind_of = 2),
g AS (SELECT page, block, any_value(kind) AS kind, CASE any_value(joint) WHEN ' | ' THEN array_to_string(list(text ORDER BY line), ' | ') ELSE array_to_string(list(text ORDER BY line), chr(10)) END AS text FROM b GROUP BY page, block),
p AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY block) - 1 AS INTEGER) AS place, kind, text FROM g)
SELECT page, place, CASE WHEN place = 0 AND kind = 'paragraph' AND length(text) < 120 AND NOT contains(text, ' ') THEN 'heading' ELSE kind END AS kind, text FROM p""",
    "outcome_profiles": _PROFILES + " SELECT label, chunks, documents, prerequisites, bloom, CAST(difficulty AS DOUBLE) AS difficulty, CAST(hours AS DOUBLE) AS hours, outcome_id, statement FROM pr",
    "outcome_layer": _PROFILES + " SELECT 'MAPS_TO' AS type, label AS source, outcome_id AS target, CAST(1 AS DOUBLE) AS weight FROM pr UNION ALL SELECT 'PREREQUISITE_OF', a.outcome_id, b.outcome_id, least(1.0, round(score, 4)) FROM vw JOIN pr a ON a.label = prerequisite JOIN pr b ON b.label = concept",
    "subject_concepts": _PROFILES + ", su AS (SELECT label, heading AS subject, count(*) AS chunks FROM fo GROUP BY ALL) SELECT subject, rank, label, chunks, bloom FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY chunks DESC, label) AS rank FROM (SELECT su.*, pr.bloom FROM su JOIN pr USING (label))) WHERE rank <= 3",
    "hybrid_anchored": _hybrid(),
    "archive_gate": """
WITH x AS (SELECT doc_id, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, CASE k WHEN 0 THEN 2 WHEN 3 THEN 3 END::BIGINT AS members, CASE WHEN k IN (0, 3) THEN k = 3 END AS macros, CASE k WHEN 1 THEN 'corrupt word/stored.txt' WHEN 2 THEN 'truncated' WHEN 4 THEN 'no archive' END AS problem,
  CASE WHEN k IN (0, 3) THEN 2 END::BIGINT AS members_left, CASE WHEN k IN (0, 3) THEN false END AS macros_left FROM x""",
    "marking_rules": """
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS p, CASE WHEN l_linenumber <= 4 THEN 1 + (l_orderkey % 50 + l_linenumber) % 3 ELSE 1 END AS most, l_linestatus = 'F' AS given, CASE WHEN l_returnflag <> 'A' THEN CAST(floor(l_quantity) AS INT) % 6 - 1 END AS marks FROM lineitem),
s AS (SELECT k, sum(greatest(0, least(coalesce(marks, CASE WHEN given THEN most ELSE 0 END), most))) AS total, count(DISTINCT CASE WHEN p <= 4 THEN p END) AS met FROM t GROUP BY k),
r AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS blank, o_orderkey % 13 <> 0 AS graded, o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 AS doubt, least(1.0, (o_orderkey % 130) / 100) AS c, coalesce(total, 0) AS total, coalesce(met, 0) AS met FROM orders LEFT JOIN s ON k = o_orderkey),
v AS (SELECT *, CASE WHEN blank OR NOT graded THEN 0 ELSE least(total, 5) END AS awarded, CAST(CASE WHEN blank THEN 0.95 WHEN NOT graded THEN 0.0 WHEN doubt THEN least(c, 0.65) ELSE c END AS DOUBLE) AS confidence FROM r)
SELECT k AS answer_id, CAST(awarded AS BIGINT) AS awarded, CAST(CASE WHEN blank OR NOT graded THEN 0 ELSE 4 - met END AS BIGINT) AS omitted,
  CASE WHEN blank THEN 'blank' WHEN NOT graded THEN 'partialCredit' WHEN awarded >= 5 THEN 'fullCredit' WHEN awarded > 0 THEN 'partialCredit' ELSE 'noCredit' END AS verdict, confidence, NOT blank AND (NOT graded OR confidence < 0.75 OR doubt) AS needs_review FROM v""",
    "assessment_locks": """
WITH s AS (SELECT o_orderkey AS id, ['draft', 'review', 'approved'][o_custkey % 3 + 1] AS held FROM orders),
e AS (SELECT l_orderkey AS id, l_linenumber AS seq, ['draft', 'review', 'approved', 'published'][l_partkey % 4 + 1] AS status FROM lineitem),
n AS (SELECT *, count(*) FILTER (WHERE status IN ('approved', 'published')) OVER (PARTITION BY id ORDER BY seq, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS locks FROM e)
SELECT n.id, seq, status, coalesce(held, 'draft') IN ('draft', 'review') AND coalesce(locks, 0) = 0 AS accepted FROM n LEFT JOIN s USING (id)""",
}
