"""DuckDB SQL of folds over histories, plans, text rules and selections."""

from __future__ import annotations

from scholia.functions import scales
from scholia.functions import text as X
from scholia.plans.oracle import AGE, CHUNKS, CLIP, EDGES, EVENTS, FORWARD, FOUND, MASTERY, QUESTIONS, STOP, TOK, VALENCE, w

W = scales.FSRS_WEIGHTS
DECAY = f"(-{W[20]})"
FACTOR = f"(exp(ln(0.9) / {DECAY}) - 1)"
EASY = f"least(10.0, greatest(1.0, {W[4]} - exp(3 * {W[5]}) + 1))"
R = f"pow(1 + {FACTOR} * greatest(0.0, (t - last) / 86400000000.0) / s, {DECAY})"
D1 = f"least(10.0, greatest(1.0, {W[7]} * {EASY} + (1 - {W[7]}) * (d - {W[6]} * (g - 3) * (10 - d) / 9)))"
LAPSE = f"least(greatest({W[11]} * pow(d, -{W[12]}) * (pow(s + 1, {W[13]}) - 1) * exp((1 - {R}) * {W[14]}), 0.1), s)"
RECALL = f"least(36500.0, greatest(0.1, s * (1 + exp({W[8]}) * (11 - d) * pow(s, -{W[9]}) * (exp((1 - {R}) * {W[10]}) - 1) * CASE WHEN g = 2 THEN {W[15]} ELSE 1.0 END)))"
#: A history's events one after another: a review changes difficulty and stability, a watch keeps 0.4 of it.
CARDS = f"""
hs AS (SELECT learner_id, concept_id, kind, outcome, t_us AS t, row_number() OVER (PARTITION BY learner_id, concept_id ORDER BY t_us, seq) AS i,
  CASE WHEN kind = 'answer' AND outcome IS NOT NULL THEN CASE WHEN outcome >= 0.5 THEN 3.0 WHEN outcome >= 0.3 THEN 2.0 ELSE 1.0 END ELSE 3.0 END AS g, kind = 'answer' AND outcome IS NOT NULL AS ans, kind = 'watch' AS wat FROM ev),
fo1(learner_id, concept_id, i, d, s, reps, lapses, last, seen, nights) AS (
  SELECT DISTINCT learner_id, concept_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM hs
  UNION ALL
  SELECT learner_id, concept_id, i + 1, CASE WHEN rev THEN nd ELSE d END, CASE WHEN wat AND reps > 0 THEN 0.4 ELSE 1.0 END * CASE WHEN rev THEN ns ELSE s END, reps + rev::INT, lapses + (ans AND reps > 0 AND g = 1)::INT, CASE WHEN rev THEN t ELSE last END, t, nights + (seen > 0 AND (t - seen) / 86400000000.0 BETWEEN 1 AND 2)::INT
  FROM (SELECT f.*, h.t, h.g, h.ans, h.wat, h.ans OR (h.wat AND f.reps > 0) AS rev,
      round(CASE WHEN f.reps = 0 THEN least(10.0, greatest(1.0, {W[4]} - exp((g - 1) * {W[5]}) + 1)) ELSE {D1} END, 8) AS nd,
      round(CASE WHEN f.reps = 0 THEN greatest(0.1, CASE g WHEN 1 THEN {W[0]} WHEN 2 THEN {W[1]} ELSE {W[2]} END) WHEN g = 1 THEN {LAPSE} ELSE {RECALL} END, 8) AS ns
    FROM (SELECT learner_id, concept_id, i, d, CASE WHEN reps = 0 THEN 1.0 ELSE s END AS s, reps, lapses, last, seen, nights FROM fo1) f JOIN hs h ON h.learner_id = f.learner_id AND h.concept_id = f.concept_id AND h.i = f.i + 1)),
ca AS (SELECT learner_id, concept_id, max_by(d, i) AS difficulty, max_by(CASE WHEN reps > 0 THEN s ELSE 0.0 END, i) * least(pow(1.04, max(nights)), 1.3) AS stability, CAST(max(reps) AS BIGINT) AS reps, CAST(max(lapses) AS BIGINT) AS lapses, CASE WHEN max(reps) > 0 THEN max(last) END AS last_review_us, CAST(max(nights) AS BIGINT) AS nights FROM fo1 GROUP BY ALL)"""


def kept(more: int) -> str:
    since = f"greatest(0.0, {AGE.replace('t_us', 'last_review_us')})"
    return f"CASE WHEN reps > 0 THEN greatest(0.05, pow(1 + {FACTOR} * ({since} + {more}) / stability, {DECAY})) ELSE 0.05 END"


FORECAST = f"""
fc AS (SELECT learner_id, concept_id, stability, reps, {kept(0)} AS retention, {", ".join(f"{kept(h)} AS retention_{h}" for h in (1, 5, 14, 30, 90))}, CASE WHEN reps > 0 THEN stability / {FACTOR} * (pow(0.6, 1 / {DECAY}) - 1) ELSE 0.0 END AS days_until_forgotten FROM ca)"""
EFFICACY = f"""
sb AS (SELECT learner_id, concept_id, sum(CASE WHEN kind = 'answer' THEN exp(-{AGE} / 7.0) END) AS w0, sum(CASE WHEN kind = 'answer' THEN exp(-{AGE} / 7.0) * outcome END) AS wo, avg({VALENCE.format('affect')}) AS affect, list(outcome ORDER BY seq) FILTER (kind = 'answer' AND outcome IS NOT NULL) AS os FROM ev GROUP BY ALL),
sx AS (SELECT learner_id, concept_id, CASE WHEN w0 > 0 THEN wo / w0 ELSE 0.0 END AS accuracy, affect, os FROM sb),
se AS (SELECT learner_id, concept_id, accuracy, affect, {CLIP.format("list_reduce(list_prepend(0.5 * accuracy + 0.2 * affect + 0.15, coalesce(os, [])), lambda e, o: CASE WHEN o >= 0.5 THEN e + 0.35 * (1 - e) ELSE e - 0.45 * e END)")} AS efficacy FROM sx),
sf AS (SELECT *, efficacy - accuracy AS calibration, CASE WHEN efficacy - accuracy >= 0.15 THEN 'overconfident' WHEN efficacy - accuracy <= -0.15 THEN 'underconfident' ELSE 'calibrated' END AS verdict FROM se)"""
MOMENTUM = "mo AS (SELECT learner_id, concept_id, avg((outcome >= 0.5)::INT) AS momentum FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, concept_id ORDER BY seq DESC) AS n FROM ev WHERE kind = 'answer' AND outcome IS NOT NULL) WHERE n <= 5 GROUP BY ALL)"


def _window(name: str, inside: str) -> str:
    day = f"CAST(floor(t_us / 86400000000.0) AS BIGINT)"
    weight = f"exp(-{AGE} / 7.0)"
    return (
        f"count(*) FILTER ({inside} AND kind = 'answer') AS {name}_n, sum({weight}) FILTER ({inside} AND kind = 'answer') AS {name}_w, sum({weight} * outcome) FILTER ({inside} AND kind = 'answer') AS {name}_wo, sum({weight}) FILTER ({inside}) AS {name}_ww, sum({weight} * {VALENCE.format('affect')}) FILTER ({inside}) AS {name}_wv, "
        f"count(DISTINCT {day}) FILTER ({inside} AND {AGE} >= 0 AND {AGE} <= 14) AS {name}_days, max({day}) FILTER ({inside} AND {AGE} >= 0 AND {AGE} <= 14) - min({day}) FILTER ({inside} AND {AGE} >= 0 AND {AGE} <= 14) AS {name}_span"
    )


def _parts(n: str) -> str:
    acc = f"CASE WHEN {n}_w > 0 THEN {n}_wo / {n}_w ELSE 0.5 END"
    pers = "CASE WHEN {0}_days <= 1 THEN 0.0 ELSE {1} END".format(n, CLIP.format(f"{n}_days / 14 * ({n}_days - 1) / greatest(1, {n}_span)"))
    val = f"CASE WHEN {n}_ww > 0 THEN {n}_wv / {n}_ww ELSE 0.6 END"
    return f"{acc} AS {n}_acc, least(1.0, {n}_n / 5) AS {n}_trust, {pers} AS {n}_p, {val} AS {n}_v, {n}_ww"


def _scored(n: str) -> str:
    comp = f"({n}_trust * {n}_acc + (1 - {n}_trust) * 0.5)"
    eng = f"(0.6 * {n}_v * (0.5 + 0.5 * {n}_p) + 0.4 * {n}_acc)"
    return f"{comp} AS {n}_c, {eng} AS {n}_e, CASE WHEN {n}_ww IS NULL THEN 0.5 ELSE {CLIP.format(f'0.4 * {comp} + 0.4 * {eng} + 0.2 * {n}_p')} END AS {n}_s"


GUIDANCE = """
gb AS (SELECT *, row_number() OVER (PARTITION BY learner_id, concept_id ORDER BY seq DESC) AS back, count(outcome) OVER (PARTITION BY learner_id, concept_id) AS m, CASE WHEN kind = 'answer' AND outcome IS NOT NULL THEN row_number() OVER (PARTITION BY learner_id, concept_id, outcome IS NOT NULL ORDER BY seq) END AS i FROM ev),
gs AS (SELECT learner_id, concept_id, count(*) AS num, count(*) FILTER (kind = 'answer' AND outcome >= 0.5) / count(*) AS acc, count(*) FILTER (back <= 3 AND affect = 'frustrated') AS fr, max(difficulty) AS difficulty, max(m) AS m, avg(outcome) FILTER (i <= floor(m / 2)) AS head, avg(outcome) FILTER (i > floor(m / 2)) AS tail FROM gb GROUP BY ALL),
gr0 AS (SELECT *, m >= 4 AND coalesce(tail > head + 0.05, false) AS rising FROM gs),
gm AS (SELECT learner_id, concept_id, unnest([CASE WHEN fr >= 3 THEN {'priority': 1, 'key': 'break_frustration'} END, CASE WHEN fr BETWEEN 1 AND 2 AND NOT rising THEN {'priority': 2, 'key': 'reassure_single_spike'} END, CASE WHEN fr BETWEEN 1 AND 2 AND rising AND acc >= 0.3 THEN {'priority': 3, 'key': 'encourage_rising'} END,
  CASE WHEN fr BETWEEN 1 AND 2 AND acc >= 0.7 AND num >= 3 THEN {'priority': 4, 'key': 'praise_effort'} END, CASE WHEN fr < 1 AND acc >= 0.7 AND num >= 3 AND difficulty / 5 >= 0.7 THEN {'priority': 4, 'key': 'praise_difficulty'} END, CASE WHEN fr < 3 AND acc < 0.4 AND num BETWEEN 1 AND 2 THEN {'priority': 6, 'key': 'scaffold_study_together'} END]) AS x FROM gr0)"""
PLAN = """
pl(id, depth) AS (SELECT source, 1 FROM fw WHERE target = 'c19' UNION SELECT fw.source, depth + 1 FROM pl JOIN fw ON fw.target = pl.id WHERE depth < 4),
sn AS (SELECT DISTINCT id FROM pl UNION SELECT 'c19'),
pe AS (SELECT source, target FROM fw WHERE source IN (SELECT id FROM pl) AND target IN (SELECT id FROM sn)),
lv(id, level) AS (SELECT DISTINCT source, 0 FROM pe WHERE source NOT IN (SELECT target FROM pe) UNION SELECT pe.target, level + 1 FROM lv JOIN pe ON pe.source = lv.id),
l2 AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY id)"""
NEAR_CLASSES = f"""
ws0 AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP}))) AS ws FROM documents),
nc AS (SELECT id, CASE WHEN len(ws) >= 4 THEN min(id) OVER (PARTITION BY ws) ELSE id END AS class, ws FROM ws0)"""
SPLIT = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINES = r"\r\n|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def share(text: str, pattern: str) -> str:
    return f"CASE WHEN length({text}) > 0 THEN (length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))) / length({text}) ELSE 0.0 END"


NOISE = "[^A-Za-z0-9 .,;:''\"()\\[\\]/\\-–—+=%°?!*&#\\n\\t→×÷±≤≥√∞²³]"
SIGILS = "[${}|~^\\\\`©¡«»¥¤§¨ª¬¯µ¶·¸¹º½¾]"
VOTES = w(CHUNKS, FOUND.replace("WT", "1").replace("WB", "2"))
PROFILE = """
pf AS (SELECT label, count(*) AS chunks, count(DISTINCT document_id) AS documents, (SELECT count(*) FROM vw WHERE concept = label) AS prerequisites FROM fo GROUP BY label),
pd AS (SELECT *, CAST(greatest(1.0, least(5.0, round_even(2.0 + CASE WHEN chunks < 3 THEN 1.0 WHEN chunks < 8 THEN 0.5 ELSE 0.0 END - CASE WHEN documents >= 3 THEN 0.5 ELSE 0.0 END + CASE WHEN prerequisites >= 8 THEN 1.0 WHEN prerequisites >= 4 THEN 0.5 ELSE 0.0 END, 0))) AS DOUBLE) AS difficulty FROM pf)"""
CHAPTERS = (("licences", ("license", "public", "version")), ("insults", ("idiot", "clown", "moron")), ("english", ("the", "and", "of the")))


def paper() -> str:
    """One CTE a section: its best questions among those not taken yet."""
    from scholia.operators.assessment import sections

    out, before = [], "SELECT NULL::BIGINT AS id, NULL AS chapter WHERE false"
    for label, each, n, ease in sections(80):
        listed = ", ".join(f"'{x}'" for x in ease)
        score = f"quality + 0.5 * CASE chapter WHEN 'Brand#13' THEN 1.0 WHEN 'Brand#42' THEN 0.5 ELSE 0.0 END - 0.05 * (SELECT count(*) FROM ({before}) u WHERE u.chapter = qu.chapter)"
        out.append(
            f"s{label} AS (SELECT '{label}' AS section, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place, id, chapter, marks, score FROM (SELECT id, chapter, marks, {score} AS score FROM qu WHERE marks = {each} AND difficulty IN ({listed}) AND id NOT IN (SELECT id FROM ({before}) t)) QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, id) <= {n})"
        )
        before += f" UNION ALL SELECT id, chapter FROM s{label}"
    return ",\n".join(out) + ",\npp AS (" + " UNION ALL ".join(f"SELECT * FROM s{x[0]}" for x in sections(80)) + ")"


def _chapter_hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(text), '{x}')::INT" for x in words)


SQL: dict[str, str] = {
    "motivation": w(EVENTS)
    + f", ag AS (SELECT learner_id, {_window('a', 'true')}, {_window('n', f'{AGE} >= 0 AND {AGE} <= 7')}, {_window('o', f'{AGE} > 7 AND {AGE} <= 14')} FROM ev GROUP BY ALL), p1 AS (SELECT learner_id, {_parts('a')}, {_parts('n')}, {_parts('o')} FROM ag), p2 AS (SELECT *, {_scored('a')}, {_scored('n')}, {_scored('o')} FROM p1) SELECT learner_id, a_c AS competence, a_p AS persistence, a_v AS valence, a_e AS engagement, a_s AS score, n_s - o_s AS trend, CASE WHEN a_s >= 0.6 THEN 'intrinsic' WHEN a_s >= 0.35 THEN 'extrinsic' ELSE 'fragile' END AS type, a_p > 0.7 AND a_v > 0.6 AS intrinsic FROM p2",
    "fsrs_cards": w(EVENTS, CARDS) + " SELECT * FROM ca",
    "fsrs_forecast": w(EVENTS, CARDS, FORECAST) + " SELECT * FROM fc",
    "short_term_stability": w(EVENTS, CARDS) + f" SELECT learner_id, concept_id, least(36500.0, greatest(0.1, stability * greatest(1.0, pow(stability, -{W[19]}) * exp({W[17]} * {W[18]})))) AS stability FROM ca",
    "revision_plan": w(EVENTS, CARDS, FORECAST, MASTERY) + f", rp AS (SELECT learner_id, concept_id, fc.retention, {CLIP.format('(0.6 - fc.retention) / 0.6')} * (0.5 + 0.5 * mastery) AS priority FROM fc JOIN mastered USING (learner_id, concept_id) WHERE fc.retention < 0.6) SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY round(priority, 4) DESC, concept_id) AS rank FROM rp QUALIFY rank <= 4",
    "self_efficacy": w(EVENTS, EFFICACY) + " SELECT learner_id, concept_id, accuracy, affect, efficacy, calibration, verdict FROM sf",
    "daily_blocks": w(EVENTS, CARDS, FORECAST, MASTERY, EFFICACY) + """, db AS (SELECT learner_id, concept_id, CASE WHEN fc.retention < 0.35 THEN CASE WHEN verdict = 'overconfident' AND confident THEN 'practice' ELSE 'retrieve' END WHEN fc.retention < 0.6 THEN 'review' ELSE 'recap' END AS kind,
  CASE WHEN fc.retention < 0.35 THEN CASE WHEN verdict = 'overconfident' AND confident THEN 85.0 ELSE 90.0 END + 5 * least(1.0, (0.35 - fc.retention) / 0.35) ELSE 40 + (1 - fc.retention) END AS priority FROM fc JOIN mastered USING (learner_id, concept_id) JOIN sf USING (learner_id, concept_id) WHERE fc.retention < 0.6)
SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY round(priority * CASE kind WHEN 'retrieve' THEN 1.6 WHEN 'practice' THEN 1.4 ELSE 1.0 END, 6) DESC, concept_id) AS rank FROM db QUALIFY rank <= 6""",
    "curiosity_rank": w(EVENTS, MASTERY, MOMENTUM) + f""", cd AS (SELECT 'c' || i AS concept_id, 0.4 + (i % 6) / 10 AS difficulty, 'd' || (i % 3) AS domain FROM range(25) r(i)),
cu AS (SELECT learner_id, max_by(concept_id, (attempts, concept_id)) AS current FROM mastered GROUP BY ALL),
cp AS (SELECT l.learner_id, c.concept_id, c.difficulty, c.domain, o.domain AS own, m.mastery, mo.momentum FROM cu l CROSS JOIN cd c LEFT JOIN cd o ON o.concept_id = l.current LEFT JOIN mastered m ON m.learner_id = l.learner_id AND m.concept_id = c.concept_id LEFT JOIN mo ON mo.learner_id = l.learner_id AND mo.concept_id = c.concept_id WHERE m.mastery IS NULL OR m.mastery < 0.8),
cs AS (SELECT learner_id, concept_id, {CLIP.format("CASE WHEN mastery IS NULL THEN 0.35 + 0.2 ELSE -0.2 END + 0.35 * CASE WHEN difficulty < 0.5 OR difficulty > 0.85 THEN 0.0 ELSE exp(-0.5 * pow((difficulty - 0.65) / 0.15, 2)) END + 0.15 * coalesce((domain <> own)::INT, 0) + 0.15 * coalesce(momentum, 0.5)")} AS score FROM cp)
SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY round(score, 4) DESC, concept_id) AS rank FROM cs QUALIFY rank <= 5""",
    "parent_guidance": w(EVENTS, GUIDANCE) + " SELECT learner_id, concept_id, x.priority AS priority, x.key AS key, row_number() OVER (PARTITION BY learner_id ORDER BY x.priority, concept_id, x.key) AS rank FROM gm WHERE x IS NOT NULL QUALIFY rank <= 3",
    "prereq_plan": w(EVENTS, EDGES, FORWARD, MASTERY, PLAN) + " SELECT id, level FROM l2 WHERE id NOT IN (SELECT concept_id FROM mastered GROUP BY concept_id HAVING avg(mastery) >= 0.5)",
    "study_plan": w(EVENTS, EDGES, FORWARD) + f""", x AS (SELECT learner_id, concept_id, exp(sum(CASE WHEN kind = 'answer' AND outcome >= 0.5 THEN ln(2.2) WHEN kind = 'answer' AND outcome IS NOT NULL THEN -0.8 ELSE 0.0 END)) AS strength, max_by(t_us, seq) AS t_us FROM ev GROUP BY ALL), rt AS (SELECT learner_id, concept_id, greatest(0.05, exp(-{AGE} / strength)) AS retention FROM x),
lv(id, level) AS (SELECT DISTINCT source, 0 FROM fw WHERE source NOT IN (SELECT target FROM fw) UNION SELECT fw.target, level + 1 FROM lv JOIN fw ON fw.source = lv.id), l2 AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY id),
st2 AS (SELECT l.learner_id, l2.id, l2.level, CASE WHEN retention IS NULL THEN 'learn' WHEN retention < 0.6 THEN 'retrieve' ELSE 'skip' END AS action FROM (SELECT DISTINCT learner_id FROM rt) l CROSS JOIN l2 LEFT JOIN rt ON rt.learner_id = l.learner_id AND rt.concept_id = l2.id)
SELECT learner_id, id, level, action, CAST(CASE action WHEN 'skip' THEN 0 ELSE 20 END AS BIGINT) AS minutes, sum(CASE action WHEN 'skip' THEN 0 ELSE 20 END) OVER (PARTITION BY learner_id ORDER BY level, id ROWS UNBOUNDED PRECEDING) <= 120 AS today FROM st2""",
    "phrase_scan": w(CHUNKS) + f", pt AS (SELECT id, document_id, ' ' || array_to_string({TOK.format('text')}, ' ') || ' ' AS t, ' ' || array_to_string({TOK.format('heading')}, ' ') || ' ' AS h FROM ch) SELECT phrase, id, document_id FROM pt, (VALUES ('of the'), ('license version'), ('general public license')) v(phrase) WHERE contains(t, ' ' || phrase || ' ') OR contains(h, ' ' || phrase || ' ')",
    "rouge_l": "WITH RECURSIVE p AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark), t AS (SELECT item_id, " + TOK.format("text") + " AS a, " + TOK.format("other") + """ AS b FROM p WHERE other IS NOT NULL),
r(item_id, i, row) AS (SELECT item_id, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM t UNION ALL
  SELECT t.item_id, i + 1, list_reduce(range(1, len(b) + 1), lambda out, j: list_append(out, greatest(out[-1], row[j + 1], CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE 0 END)), [0]) FROM r JOIN t USING (item_id) WHERE i < len(a)),
l AS (SELECT item_id, max_by(row, i)[-1] AS n FROM r GROUP BY item_id) SELECT item_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * n / (len(a) + len(b)) END AS rouge FROM t JOIN l USING (item_id)""",
    "near_dup_classes": w(NEAR_CLASSES) + " SELECT id, class FROM nc",
    "near_dup_greedy": w(NEAR_CLASSES) + """, cl AS (SELECT id, ws FROM nc WHERE id = class AND len(ws) >= 4),
pr AS (SELECT x.id AS a, y.id AS b FROM cl x JOIN cl y ON x.id < y.id AND len(x.ws) >= 0.75 * len(y.ws) AND len(y.ws) >= 0.75 * len(x.ws) WHERE len(list_intersect(x.ws, y.ws)) >= 0.75 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
od AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT a AS id FROM pr UNION SELECT b FROM pr)),
gy(i, kept) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT gy.i + 1, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.b = od.id AND list_contains(kept, pr.a)) THEN kept ELSE list_append(kept, od.id) END FROM gy JOIN od ON od.i = gy.i + 1),
kp AS (SELECT unnest(max_by(kept, i)) AS id FROM gy) SELECT id, class, id = class AND (id NOT IN (SELECT id FROM od) OR id IN (SELECT id FROM kp)) AS accepted FROM nc""",
    "encoding_flags": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low, substr(coalesce(text, ''), 1, 600) AS head FROM documents), u AS (SELECT *, list_filter(string_split_regex(head, '{SPLIT}+'), lambda p: p <> '') AS ps, string_split_regex(x, '[(][a-dA-D][)]') AS bs, regexp_replace(x, '\\P{{L}}', '', 'g') AS ls FROM t)
SELECT doc_id, length(x) = 0 OR {share('head', NOISE)} > 0.15 OR {share('head', SIGILS)} > 0.03 OR len(list_filter(ps, lambda p: regexp_matches(p, '[${{}}|]'))) > 0.08 * len(ps) AS mangled,
  ({" OR ".join(f"contains(low, '{p}')" for p in X.FIGURE)}) AND NOT (contains(low, '(a)') AND contains(low, '(b)') AND contains(low, '(c)')) AS needs_figure,
  (contains(low, '(d)') AND NOT (contains(low, '(a)') AND contains(low, '(b)') AND contains(low, '(c)'))) OR (contains(low, '(c)') AND NOT (contains(low, '(a)') AND contains(low, '(b)'))) OR (contains(low, '(b)') AND NOT contains(low, '(a)')) OR (len(bs) > 2 AND len(list_filter(bs[2:], lambda p: length(trim(p, ' .:;')) < 2)) > 0) AS broken_options,
  contains(low, '(a)') AND len(list_filter(string_split_regex(x, '{LINES}'), lambda p: regexp_matches(p, '^{SPLIT}*\\p{{Nd}}{{1,3}}{SPLIT}*$'))) >= 2 AS broken_fractions,
  {share('ls', '[^' + chr(92) + 'x{0}-' + chr(92) + 'x{2FF}]')} > 0.3 AS non_latin FROM u""",
    "clean_text": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '[*][A-Za-z0-9/-]+[*]') AND NOT regexp_matches(x, '^[0-9]{1,3}$') AND NOT regexp_matches(upper(x), '^P[.]? ?T[.]? ?O[.]? ?[.]?$')) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(ls, ' '), '[0-9]{2,3}/[0-9]{1,2}/[0-9]{1,2}', ' ', 'g'), '^ *[0-9]{1,3} *[.)\\]] *', ''), ' *SECTION *-? *[A-EIVX]( .*)?$', ''), ' +[0-9]{0,2} *OR +.*$', ''), ' +[0-9]{1,2} *$', ''), ' +', ' ', 'g')) AS text FROM l""",
    "chapter_tags": "WITH h AS (SELECT doc_id, " + ", ".join(f"{_chapter_hits(ws)} AS h{i}" for i, (_, ws) in enumerate(CHAPTERS)) + " FROM documents WHERE text IS NOT NULL), b AS (SELECT *, greatest(h0, h1, h2) AS hits FROM h) SELECT doc_id, CASE WHEN hits = 0 THEN NULL WHEN h0 = hits THEN 'licences' WHEN h1 = hits THEN 'insults' ELSE 'english' END AS chapter, CAST(hits AS BIGINT) AS hits, least(1.0, hits / 3) AS confidence FROM b",
    "misconception_scores": f"WITH t AS (SELECT conv_id || ':' || turn AS turn_id, {TOK.format('text')} AS ts FROM conversations WHERE text IS NOT NULL), m AS (SELECT turn_id, 'articles' AS misconception, len(list_intersect(list_distinct(list_filter(ts, lambda x: length(x) > 1)), ['an', 'the'])) / 2 AS s FROM t UNION ALL SELECT turn_id, 'motion', len(list_intersect(list_distinct(list_filter(ts, lambda x: length(x) > 1)), ['force', 'motion', 'that', 'with'])) / 4 FROM t) SELECT turn_id, misconception, least(1.0, s) * 0.6 AS score FROM m WHERE s > 0",
    "answer_segments": r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (1 + turn % 7) || ') ' || text ELSE text END AS text FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t),
q AS (SELECT *, CASE WHEN regexp_matches(raw, '^ *(?:[Qq][. ]*)?([0-9]{1,2}) *[.)] *') THEN CAST(regexp_extract(raw, '^ *(?:[Qq][. ]*)?([0-9]{1,2}) *[.)] *', 1) AS BIGINT) END AS q, regexp_replace(raw, '^ *(?:[Qq][. ]*)?([0-9]{1,2}) *[.)] *', '') AS body FROM l),
c AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, line) AS question FROM q)
SELECT conv_id, question, string_agg(body, chr(10) ORDER BY turn, line) AS text, count(*) AS lines FROM c WHERE question IS NOT NULL GROUP BY ALL""",
    "ocr_vote": r"""WITH b AS (SELECT conv_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS norm, count(*) AS n, min(turn) AS seen, arg_min(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
SELECT conv_id, arg_min(text, (n < 2, CASE WHEN n >= 2 THEN seen ELSE -1 END, -length(text), seen)) AS text, max(n) >= 2 AS agreed FROM b GROUP BY ALL""",
    "lo_layer": VOTES + "," + PROFILE + " SELECT label, chunks, documents, prerequisites, difficulty, 0.5 * difficulty + 0.5 AS hours, 'lo:' || substr(sha1(label || ':understand'), 1, 16) AS outcome_id, 'Learners can explain ' || label AS statement FROM pd",
    "prereq_edges": VOTES + "," + PROFILE + ", je AS (SELECT vw.*, y.difficulty - x.difficulty AS jump, least(1.0, (weight + against) / 3) * (0.5 + 0.5 * (weight - against) / (weight + against)) AS confidence FROM vw JOIN pd x ON x.label = prerequisite JOIN pd y ON y.label = concept) SELECT prerequisite, concept, score, confidence, jump, CAST(greatest(1.0, round(3 * (2 - confidence) * (1 + greatest(jump, 0.0)))) AS BIGINT) AS spacing_days FROM je",
    "grade_pairs": VOTES + ", gg AS (SELECT label, min(6 + document_id % 5) AS grade FROM fo GROUP BY label) SELECT CASE WHEN x.grade < y.grade THEN a ELSE b END AS prerequisite, CASE WHEN x.grade < y.grade THEN b ELSE a END AS concept, n FROM co JOIN gg x ON x.label = a JOIN gg y ON y.label = b WHERE x.grade <> y.grade",
    "text_triples": "WITH m AS (SELECT string_split(unnest(regexp_extract_all(lower(text), '([a-z]{3,} (requires|needs|uses|is|has) [a-z]{3,})', 1)), ' ') AS p FROM documents WHERE text IS NOT NULL) SELECT p[1] AS subject, p[2] AS predicate, p[3] AS object, count(*) AS n FROM m WHERE p[1] <> p[3] GROUP BY ALL",
    "chunk_packs": w(CHUNKS) + ", e AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY document_id, heading ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stop FROM ch) SELECT document_id, heading, CAST((stop - 1) // 4000 AS BIGINT) AS pack, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS characters FROM e GROUP BY ALL",
    "select_paper": w(QUESTIONS, paper()) + " SELECT section, place, id, chapter, marks, score FROM pp",
    "assemble_paper": w(QUESTIONS, paper()) + " SELECT section, place, id, chapter, marks, score, row_number() OVER (ORDER BY section, place) AS number FROM pp",
    "question_terms": f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '\\([A-D]\\)[^(]*', ' ', 'g')), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP} AND (length(x) > 3 OR x IN ('ph', 'dna', 'rna', 'atp', 'emf', 'co2', 'h2o', 'o2'))) AS ws FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, CASE WHEN len(ws) > 0 THEN array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:5], ',') ELSE 'key idea' END AS terms FROM t""",
    "evaluate_objective": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(upper('(' || substr('ABCD', 1 + turn % 4, 1) || ') ' || text), '\b(?:OPTION\s*)?\(?([A-D])\)?\b', 1) AS ls FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id, turn, ls[1] AS chosen, len(list_distinct(ls)) AS n FROM t)
SELECT conv_id, turn, chosen, CASE WHEN chosen = 'B' THEN 'fullCredit' ELSE 'noCredit' END AS verdict, CASE WHEN chosen IS NULL THEN 0.45 WHEN n > 1 THEN 0.5 ELSE 0.93 END AS confidence, chosen IS NULL OR n > 1 AS needs_review FROM u""",
    "question_concepts": f"""WITH f(x) AS (SELECT 0), q AS (SELECT item_id AS question_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP})) AS ws FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT concept, list_distinct(list_filter(regexp_extract_all(lower(concept), '([a-z][a-z0-9-]+)', 1), lambda x: x NOT IN {STOP})) AS cs FROM (VALUES ('onesen erblest hein'), ('eroundth thwhesou the rest'), ('eaea ndorea')) v(concept)),
j AS (SELECT question_id, concept, len(list_intersect(ws, cs)) AS i, len(ws) + len(cs) AS t FROM q, c) SELECT question_id, concept, i / (t - i) AS score FROM j WHERE i > 0 AND i / (t - i) >= 0.01""",
}
