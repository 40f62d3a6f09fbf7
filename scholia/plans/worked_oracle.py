"""DuckDB SQL of the queries in `worked`."""

from __future__ import annotations

from scholia.operators.curriculum import BLOOM_VERBS
from scholia.plans.folds_oracle import paper
from scholia.plans.oracle import ANSWERS, CHUNKS, QUESTIONS, STOP, TOK, w
from scholia.sources.files import NAME_RULES, PAPER_WORDS

TURNS = "tu AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, text FROM conversations WHERE text IS NOT NULL)"


def named(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({name}), '{p}') THEN '{k}'" for p, k in NAME_RULES) + " ELSE 'unknown' END"


def synonyms(t: str, sep: str = "','") -> str:
    plain = f"[CASE WHEN ends_with({t}, 'y') THEN {t}[:-2] || 'ies' END, CASE WHEN NOT ends_with({t}, 's') THEN {t} || 's' END, CASE WHEN ends_with({t}, 's') AND length({t}) > 3 THEN {t}[:-2] END]"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_concat({plain}, CASE WHEN contains({t}, ' ') THEN list_filter(string_split({t}, ' '), lambda v: length(v) > 3) ELSE [] END), lambda v: v IS NOT NULL AND v <> {t}))), {sep})"


def bloom() -> str:
    levels = list(BLOOM_VERBS)
    verbs = list(BLOOM_VERBS.values())
    first = {}
    for level, listed in zip(levels, verbs, strict=True):
        for v in listed:
            first.setdefault(v, level)
    used = ", ".join("[" + ", ".join(f"'{v}'" for v in listed) + f"][p_partkey % {len(listed)} + 1]" for listed in verbs)
    level_of = "CASE v " + " ".join(f"WHEN '{v}' THEN {levels.index(x)}" for v, x in first.items()) + " END"
    names = ", ".join(f"'{x}'" for x in levels)
    return f"WITH u AS (SELECT p_partkey, unnest(([{used}])[1 + p_size % 5 : 2 + p_size % 5]) AS v FROM part), n AS (SELECT p_partkey, {level_of} AS l, count(*) AS n FROM u GROUP BY ALL) SELECT p_partkey, [{names}][max_by(l, (n, l)) + 1] AS bloom FROM n WHERE l IS NOT NULL GROUP BY p_partkey"


JACCARD = "(len(list_intersect(list_distinct({0}), list_distinct({1}))) / (len(list_distinct({0})) + len(list_distinct({1})) - len(list_intersect(list_distinct({0}), list_distinct({1})))))".format(TOK.format("o"), TOK.format("b"))
PAPERS = " + ".join(f"contains(low, '{x}')::INT" for x in PAPER_WORDS)

SQL: dict[str, str] = {
    "file_kinds": f"""WITH f AS (SELECT doc_id, ['Marking Scheme', 'QP_12', 'model answer of June', 'SQP set', 'Syllabus 2023', 'letter'][doc_id % 6 + 1] AS name, lower(CASE WHEN doc_id % 12 = 5 THEN 'Time allowed: 3 hours. Maximum Marks 80. ' WHEN doc_id % 12 = 11 THEN 'A model answer. ' ELSE '' END || text) AS low FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, {named('name')} AS by_name, low, {PAPERS} AS n FROM f)
SELECT doc_id, by_name, CASE WHEN by_name <> 'unknown' THEN by_name WHEN contains(low, 'marking scheme') AND n >= 2 THEN 'marking_scheme' WHEN n >= 2 THEN 'question_paper' WHEN contains(low, 'model answer') THEN 'model_answer' WHEN contains(low, 'curriculum') AND (contains(low, 'learning outcomes') OR contains(low, 'course content')) THEN 'curriculum' ELSE 'unknown' END AS kind FROM g""",
    "file_gate": """WITH f AS (SELECT page_id, ['pdf', 'zip', 'html'][page_id % 3 + 1] AS extension, CASE page_id % 5 WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN 'PK' || chr(3) || chr(4) ELSE '' END || html AS c FROM pages WHERE html IS NOT NULL),
g AS (SELECT *, octet_length(encode(c)) AS n, lower(substr(c, 1, 512)) AS head, substr(c, 1, 4) AS magic FROM f)
SELECT page_id, array_to_string(list_filter([CASE WHEN n < 16 THEN 'trivially small' END, CASE WHEN extension = 'pdf' AND n < 2048 THEN 'small pdf' END, CASE WHEN extension <> 'html' AND n < 4096 AND regexp_matches(head, '<html|<title>|error|not found|500|404') THEN 'html error page' END,
  CASE WHEN extension = 'pdf' AND n > 0 AND magic <> '%PDF' THEN 'no pdf magic' END, CASE WHEN extension = 'zip' AND n > 0 AND magic <> 'PK' || chr(3) || chr(4) THEN 'no zip magic' END, CASE WHEN extension = 'zip' AND magic = 'PK' || chr(3) || chr(4) THEN 'no zip members' END], lambda x: x IS NOT NULL), ';') AS problems FROM g""",
    "upload_gate": """WITH u AS (SELECT o_orderkey AS upload_id, o_custkey + 100 * (o_orderkey % 2) AS source_id, ['pdf', 'exe', 'DOCX', 'txt'][o_orderkey % 4 + 1] AS extension, o_orderkey % 3 > 0 AS ok FROM orders)
SELECT upload_id, CASE WHEN extension = 'exe' THEN 'unsupported type' WHEN NOT ok THEN 'copyright not confirmed' WHEN source_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0) OR row_number() OVER (PARTITION BY source_id ORDER BY upload_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM u""",
    "path_metadata": """SELECT p_partkey, ['Mathematics', 'Social Science', 'Mathematics', 'English', NULL][p_partkey % 5 + 1] AS subject, ['X', 'XII', NULL][p_partkey % 3 + 1] AS grade, '3' || (p_partkey % 3) || '/' || (p_partkey % 9) || '/1' AS code FROM part""",
    "answer_key_scan": w(TURNS) + """,
pg AS (SELECT conv_id AS path, turn AS page, CASE WHEN turn = 0 THEN '3' || (conv_id % 3) || '/1/2' END AS code, (turn + 1) || '. ' || ['A', '(B)', 'C', 'D'][turn % 4 + 1] || chr(10) || (turn + 2) || ') (A)' || chr(10) || text AS body FROM tu),
pc AS (SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY path ORDER BY page) AS paper_code FROM pg),
pm AS (SELECT path, paper_code, page, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM (SELECT *, regexp_extract_all(body, '(?m)^\\s*([0-9]{1,2}[.)]?\\s+\\(?[A-D]\\)?)(?:\\s|$)', 1) AS ms FROM pc WHERE paper_code IS NOT NULL)),
pr AS (SELECT path, paper_code, page, pos, CAST(regexp_extract(m, '([0-9]{1,2})', 1) AS INTEGER) AS q_no, regexp_extract(m, '([A-D])\\)?$', 1) AS option FROM pm)
SELECT path, paper_code, q_no, arg_min(option, (page, pos)) AS option FROM pr WHERE q_no BETWEEN 1 AND 20 GROUP BY ALL""",
    "answer_key_lookup": """WITH q AS (SELECT p_partkey AS id, ['Science', 'English'][p_partkey % 2 + 1] AS subject, ['X', 'XII'][p_size % 2 + 1] AS grade, '31/1/' || (p_size % 4) AS code, p_size % 20 AS q_no FROM part),
k AS (SELECT ['Science', 'English'][s_suppkey % 2 + 1] AS subject, ['X', ''][s_suppkey % 3 % 2 + 1] AS grade, '31/1/' || (s_suppkey % 4) AS code, s_suppkey % 20 AS q_no, ['A', 'B', 'C', 'D'][s_suppkey % 4 + 1] AS option FROM supplier)
SELECT q.id, max_by(option, (k.grade <> '', option)) AS option FROM q LEFT JOIN k ON q.code = k.code AND q.q_no = k.q_no AND q.subject = k.subject AND (q.grade = k.grade OR k.grade = '') GROUP BY q.id""",
    "question_maps": w(TURNS) + r" SELECT substr(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 16) AS key, min(conv_id * 100 + turn) AS at FROM tu GROUP BY ALL",
    "fused_pages": """WITH e AS (SELECT doc_id % 50 AS document_id, ['native', 'ocr', 'vlm'][doc_id % 3 + 1] AS provider, 0.5 + doc_id % 3 / 10 AS confidence, doc_id // 50 AS page, text, doc_id % 10 / 10 AS quality FROM documents WHERE text IS NOT NULL),
s AS (SELECT document_id, provider, max(confidence) * avg(quality) * avg((length(text) >= 80)::INT) AS score FROM e GROUP BY ALL), b AS (SELECT document_id, max_by(provider, (score, provider)) AS best FROM s GROUP BY ALL),
p AS (SELECT document_id, page, arg_max(provider, (quality, provider, text)) FILTER (provider = best) AS op, max(quality) FILTER (provider = best) AS oq, arg_max(provider, (quality, provider, text)) AS tp, max(quality) AS tq FROM e JOIN b USING (document_id) GROUP BY ALL)
SELECT document_id, page, CASE WHEN oq >= 0.5 THEN op ELSE tp END AS provider, CASE WHEN oq >= 0.5 THEN oq ELSE tq END AS quality FROM p""",
    "stem_options": "SELECT p_partkey, 'A=' || trim(p_brand, ' .;') || '|B=' || trim(p_type, ' .;') || '|C=' || p_size AS options FROM part",
    "scheme_points": """WITH p AS (SELECT p_partkey, p_size, string_split(p_name, ' ')[1 : 1 + p_size % 4] AS ks FROM part) SELECT p_partkey, array_to_string(list_transform(ks, lambda k, i: k || ':' || (p_size // len(ks) + CASE WHEN i <= p_size % len(ks) THEN 1 ELSE 0 END)), ',') AS points FROM p""",
    "evidence_gate": r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS d, CASE WHEN doc_id % 10 > 0 THEN doc_id % 7 / 7 END AS c, substr(text, 5, 4 + doc_id % 9) AS snip, text FROM documents)
SELECT doc_id, CASE WHEN d IS NULL AND c IS NULL THEN 'no provenance' WHEN coalesce(d, '') = '' THEN 'missing document_id' WHEN coalesce(c, 0.0) < 0.5 THEN 'confidence below 0.5' ELSE 'ok' END AS reason,
  coalesce(length(snip) >= 8 AND contains(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')), trim(regexp_replace(lower(snip), '[ \t\n\r\f\x0B]+', ' ', 'g'))), false) AS quoted FROM r""",
    "scrubbed_text": "SELECT doc_id, trim(array_to_string(list_filter(string_split(text || chr(10) || chr(10) || 'As an AI I see' || chr(10) || chr(10) || source, chr(10) || chr(10)), lambda b: NOT contains(lower(b), 'as an ai') AND NOT contains(lower(b), 'version')), chr(10) || chr(10))) AS text FROM documents WHERE text IS NOT NULL",
    "scan_sessions": """WITH p AS (SELECT DISTINCT l_orderkey AS session, l_partkey + 50 * (l_linenumber % 2) AS q, l_linenumber AS i, (SELECT max(l_returnflag) FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber AND o.l_quantity > 20) AS answer FROM lineitem l),
s AS (SELECT session, CASE WHEN q NOT IN (SELECT p_partkey FROM part) THEN 'noMatch' WHEN answer IS NULL AND session IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) THEN 'review' WHEN answer IS NULL THEN 'blank' ELSE 'answered' END AS state FROM p) SELECT state, count(*) AS n, count(DISTINCT session) AS sessions FROM s GROUP BY ALL""",
    "evidence_events": w(ANSWERS) + ", e AS (SELECT student AS learner_id, unnest([concept, gap]) AS concept_id, awarded / max_marks AS outcome, CASE WHEN awarded > 40 THEN 0.3 WHEN awarded > 20 THEN 0.6 ELSE 0.9 END AS difficulty FROM an) SELECT learner_id, concept_id, count(*) AS n, avg(outcome) AS outcome, max(difficulty)::DOUBLE AS difficulty FROM e GROUP BY ALL",
    "top_evidence": "SELECT source AS key, doc_id AS document_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 / 97 DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 3",
    "merged_beliefs": f"SELECT p_partkey, array_to_string(list_reduce([p_name, p_name || ' too', 'heavy things do fall faster', p_type], lambda out, b: CASE WHEN len(list_filter(out, lambda o: {JACCARD} >= 0.4)) > 0 THEN out ELSE list_append(out, b) END, ['force keeps things in motion', 'heavy things fall faster']), '|') AS beliefs FROM part",
    "page_tables": """WITH s AS (SELECT l_orderkey AS page, 50.0 * ((l_linenumber - 1) % 3) + l_suppkey % 9 AS x, floor((l_linenumber - 1) / 3) * 10.0 + (l_linenumber - 1) % 3 * 0.5 AS y, l_returnflag || l_linenumber AS text FROM lineitem),
n AS (SELECT *, coalesce((y - lag(y) OVER (PARTITION BY page ORDER BY y, x) > 3)::INT, 0) AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS row FROM n),
g AS (SELECT *, x - lag(x) OVER (PARTITION BY page, row ORDER BY x) AS gap FROM r)
SELECT page, CAST(row AS BIGINT) AS row, count(*) AS cells, string_agg(text, ' | ' ORDER BY x, text) AS text FROM g GROUP BY page, row HAVING count(*) >= 3 AND min(gap) > 8 AND min(gap) >= 0.6 * avg(gap)""",
    "page_quality": w(TURNS) + " SELECT conv_id AS document_id, avg((turn % 4 <> 3 AND length(trim(text)) > 0 AND NOT (contains(lower(text), 'idiot') OR contains(lower(text), 'version')))::INT) AS quality, count(*) AS pages FROM tu GROUP BY ALL",
    "status_guard": """WITH c AS (SELECT o_orderkey AS id, ['draft', 'reviewed', 'published', 'archived'][o_orderkey % 4 + 1] AS before, ['draft', 'reviewed', 'published', 'archived'][o_custkey % 4 + 1] AS after FROM orders) SELECT *, (before, after) IN (('draft', 'reviewed'), ('reviewed', 'draft'), ('reviewed', 'published'), ('published', 'archived')) AS allowed FROM c""",
    "review_totals": """SELECT l_orderkey AS session, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 100 ELSE l_quantity END) AS awarded, 50.0 * count(*) AS max_marks, count(*) FILTER (l_partkey % 3 <> 1 AND l_linenumber % 3 <> 0) AS open FROM lineitem GROUP BY ALL""",
    "json_salvage": "SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE props END AS json FROM events",
    "retracted_nodes": "WITH g AS (SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS gone FROM customer) SELECT id, CASE WHEN gone THEN 'retracted' ELSE 'active' END AS status, CASE WHEN gone THEN '2024-02-01' END AS valid_until FROM g",
    "candidate_concepts": "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9-]{2,})', 1), lambda t: lower(t) NOT IN ('the', 'and', 'for', 'with', 'what', 'how', 'why', 'when', 'which', 'explain', 'define', 'list', 'state', 'describe', 'marks', 'class', 'question', 'paper', 'section', 'part', 'difference', 'between'))[1:5], ',') AS concepts FROM documents WHERE text IS NOT NULL",
    "ordered_distinct": f"WITH t AS (SELECT item_id, {TOK.format('text')} AS ws FROM benchmark WHERE text IS NOT NULL) SELECT item_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM t",
    "bloom_votes": bloom(),
    "paper_metrics": w(QUESTIONS, paper()) + ", m AS (SELECT pp.marks, qu.chapter, qu.bloom, qu.difficulty FROM pp JOIN qu USING (id)) SELECT kind, value, count(*) AS questions, CAST(sum(marks) AS BIGINT) AS marks FROM (SELECT marks, 'chapter' AS kind, chapter AS value FROM m UNION ALL SELECT marks, 'bloom', bloom FROM m UNION ALL SELECT marks, 'difficulty', difficulty FROM m) GROUP BY ALL",
    "restricted_phrases": w(CHUNKS) + f", t AS (SELECT id, document_id, ' ' || array_to_string({TOK.format('text')}, ' ') || ' ' AS t, ' ' || array_to_string({TOK.format('heading')}, ' ') || ' ' AS h FROM ch WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT phrase, id, document_id FROM t, (VALUES ('and the'), ('of')) v(phrase) WHERE contains(t, ' ' || phrase || ' ') OR contains(h, ' ' || phrase || ' ')",
    "nearest_words": """WITH r AS (SELECT l_orderkey AS page, 1 AS line, l_partkey * 10 + l_linenumber AS x, l_returnflag || l_linestatus || l_linenumber AS word, l_linenumber % 3 = 0 AS dash FROM lineitem)
SELECT m.page, m.line, m.x, (SELECT max_by(word, (x, word)) FROM r o WHERE NOT dash AND o.page = m.page AND o.x <= m.x) AS "left", (SELECT min_by(word, (x, word)) FROM r o WHERE NOT dash AND o.page = m.page AND o.x >= m.x) AS "right" FROM r m WHERE dash""",
    "contained_concepts": f"""WITH q AS (SELECT p_partkey AS question_id, ' ' || array_to_string({TOK.format("p_name || ' ' || p_type")}, ' ') || ' ' AS t FROM part), c AS (SELECT DISTINCT unnest([string_split(p_name, ' ')[1], lower(p_type)]) AS concept FROM part WHERE p_partkey % 40 = 0)
SELECT question_id, concept FROM q JOIN c ON contains(t, ' ' || array_to_string({TOK.format('concept')}, ' ') || ' ') QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(concept) DESC, concept) = 1""",
    "term_synonyms": f"WITH t AS (SELECT DISTINCT unnest([p_name, p_type, string_split(p_name, ' ')[1], 'Energy', 'gas', 'bus']) AS term FROM part) SELECT term, {synonyms('lower(term)')} AS synonyms FROM t",
    "answer_schemes": f"""WITH q AS (SELECT p_partkey AS id, p_size AS n, p_name, p_type, greatest(1, p_size % 6) AS m, CASE WHEN p_size % 8 = 0 THEN 'B' WHEN p_size % 5 = 0 THEN 'C' END AS o FROM part),
t AS (SELECT *, list_filter(regexp_extract_all(lower(p_name || ' and ' || lower(p_type) || ' energy'), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP} AND length(x) > 3) AS ws FROM q),
u AS (SELECT *, list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:m] AS ts FROM t)
SELECT id, n % 4 = 0 OR n % 5 = 0 AS objective, CASE WHEN n % 4 = 0 OR n % 5 = 0 THEN (CASE WHEN o IS NULL THEN '' WHEN n % 4 = 0 AND o = 'B' THEN 'two ' || p_type ELSE o END) || ':' || m || ':true:' || coalesce(o, '')
  WHEN n % 3 = 0 THEN string_split(p_name, ' ')[1] || ':' || (m // 2 + m % 2) || ':true:|' || string_split(p_type, ' ')[1] || ':' || (m // 2) || ':false:'
  ELSE array_to_string(list_transform(ts, lambda x, i: x || ':' || CASE WHEN i = 1 THEN 1 + m - len(ts) ELSE 1 END || ':' || (i = 1) || ':' || {synonyms('x', "'+'")}), '|') END AS points FROM u""",
    "file_duplicates": "WITH f AS (SELECT page_id AS path, sha256(html) AS sha256, 'src:' || page_id AS source_id FROM pages) SELECT path, sha256, source_id, CASE WHEN path <> min(path) OVER (PARTITION BY sha256) THEN source_id END AS duplicate_of FROM f WHERE sha256 IS NOT NULL",
}


def _fallback() -> str:
    """Like the paper, from one chapter group first and the others where it falls short."""
    from scholia.operators.assessment import sections

    out, before = [], "SELECT NULL::BIGINT AS id, NULL AS chapter WHERE false"
    for label, each, n, ease in sections(80):
        listed = ", ".join(f"'{x}'" for x in ease)
        score = f"quality - 0.05 * (SELECT count(*) FROM ({before}) u WHERE u.chapter = qu.chapter)"
        out.append(
            f"s{label} AS (SELECT '{label}' AS section, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place, id, chapter FROM (SELECT id, chapter, {score} AS score, chapter > 'Brand#12' AS other FROM qu WHERE marks = {each} AND difficulty IN ({listed}) AND id NOT IN (SELECT id FROM ({before}) t) QUALIFY row_number() OVER (ORDER BY other, round(score, 9) DESC, id) <= {n}))"
        )
        before += f" UNION ALL SELECT id, chapter FROM s{label}"
    return w(QUESTIONS, ",\n".join(out)) + " " + " UNION ALL ".join(f"SELECT section, place, id FROM s{x[0]}" for x in sections(80))


SQL["fallback_paper"] = _fallback()
