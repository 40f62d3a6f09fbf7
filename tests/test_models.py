"""Hand-computed values and properties."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import assessment, curriculum, graph, learners, memory, retrieval
from scholia.plans import suite

NOW = datetime.datetime(2026, 1, 31)
DAY = 86_400_000_000
NOW_US = int(NOW.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000


def events(spark, rows):
    """rows: days ago, kind, outcome, bloom, affect."""
    full = [(1, i, "c", kind, outcome, bloom, 1.0, affect, 60.0, NOW_US - int(days * DAY), i) for i, (days, kind, outcome, bloom, affect) in enumerate(rows, 1)]
    df = spark.createDataFrame(full, "learner_id int, event_id long, concept_id string, kind string, outcome double, bloom string, difficulty double, affect string, duration_sec double, t_us long, seq long")
    return df.withColumn("ts", F.timestamp_micros("t_us"))


def test_mastery(spark):
    rows = [(0, 1.0, "remember"), (0, 0.0, "remember"), (2, 1.0, "understand"), (5, 1.0, "apply"), (9, 1.0, "analyze"), (12, 1.0, "apply")]
    r = learners.mastery(events(spark, [(d, "answer", o, b, None) for d, o, b in rows]), F.lit(NOW_US)).first()
    assert [round(x, 4) for x in (r.accuracy, r.confidence, r.retention, r.application, r.mastery)] == [0.8333, 0.7296, 0.4244, 1.0, 0.7180]


def test_fsrs(spark):
    log = [(12, 1.0), (9, 1.0), (2, 0.0), (0, 0.4)]
    want = [(2.11810397, 2.3065), (2.11698587, 13.82690369), (7.39990686, 1.61432731), (8.26493701, 3.63289365)]
    for n in range(1, 5):
        r = memory.cards(events(spark, [(d, "answer", o, None, None) for d, o in log[:n]])).first()
        gain = min(1.04**r.nights, 1.3)
        assert (r.difficulty, round(r.stability / gain, 6)) == pytest.approx(want[n - 1], abs=2e-6)
    assert (r.reps, r.lapses) == (4, 1)


def test_forgetting_curve(spark):
    r = spark.range(1).select(memory.curve(F.lit(5.0), F.lit(3.63289365)).alias("a"), memory.days_to(0.6, F.lit(3.63289365)).alias("b")).first()
    assert memory.FACTOR == pytest.approx(0.98034649, abs=1e-8)
    assert (r.a, r.b) == (pytest.approx(0.876602, abs=1e-6), pytest.approx(98.055173, abs=1e-4))


def test_exponential(spark):
    r = memory.exponential(events(spark, [(3, "answer", 1.0, None, None), (2, "answer", 1.0, None, None), (1, "answer", 0.0, None, None)]), F.lit(NOW_US)).first()
    assert r.strength == pytest.approx(2.1748, abs=1e-4)


def test_self_efficacy(spark):
    r = learners.self_efficacy(events(spark, [(0, "answer", 0.0, None, "confident"), (3, "answer", 0.0, None, "confident"), (7, "answer", 1.0, None, "engaged")]), F.lit(NOW_US)).first()
    assert [round(x, 4) for x in (r.efficacy, r.accuracy, r.affect, r.calibration)] == [0.4341, 0.1822, 0.9333, 0.2519]
    assert r.verdict == "overconfident"


def test_habits(spark):
    r = learners.habits(events(spark, [(d, "watch", None, None, None) for d in (0, 1, 2, 5, 6)]), F.lit(NOW_US)).first()
    assert (r.current_streak, r.longest_streak, round(r.consistency_7, 4), r.phase, round(r.risk, 4)) == (3, 3, 0.7143, "forming", 0.2857)


def test_attention(spark):
    t0 = NOW_US
    rows = events(spark, [(0, "watch", None, None, None), (0, "watch", None, None, "engaged"), (0, "watch", None, None, "frustrated")]).withColumn("t_us", F.lit(t0) + (F.col("seq") - 1) * 600_000_000)
    got = [(round(r.hazard, 4), round(r.attention, 4), r.state) for r in learners.attention(rows).orderBy("event_id").collect()]
    assert [(a, b) for a, b, _ in got] == [(1.0, 1.0), (0.9, 0.8239), (1.2, 0.067)]
    assert got[-1][2] == "fatigued"


def test_academic_year(spark):
    r = spark.range(1).select(learners.academic_year(F.lit("2026-03-31").cast("date")).alias("a"), learners.academic_year(F.lit("2026-04-01").cast("date")).alias("b")).first()
    assert (r.a, r.b) == ("2025-26", "2026-27")


def test_rrf(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, id string, rank int")
    assert {r.id: round(r.score, 8) for r in retrieval.rrf(one, two).collect()} == {"a": 0.03252247, "b": 0.03252247}


def test_bm25(spark):
    chunks = spark.createDataFrame([("a", "water cycle", "water is a liquid water"), ("b", "", "the cat sat on the mat"), ("c", "force", "force and water motion"), ("d", "x", "plain text here only"), ("e", "y", "another row of text")], "id string, heading string, text string").withColumn("document_id", F.col("id"))
    got = {r.id: round(r.score, 6) for r in retrieval.bm25(chunks, spark.createDataFrame([(1, "water force")], "query_id int, query string")).collect()}
    assert got == {"a": 0.501857, "c": 1.909423}


def test_ndcg(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3)], "query_id int, id string, rank int")
    r = retrieval.metrics(ranking, spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0)], "query_id int, id string, gain double"), 3).first()
    assert (round(r.ndcg, 8), r.mrr, round(r.precision, 4), r.recall) == (0.96394043, 1.0, 0.6667, 1.0)


def test_timetable(spark):
    units = spark.createDataFrame([(1, 25), (2, 25), (3, 30)], "unit_no int, marks int")
    assert [r.periods for r in assessment.timetable(units, 6, 2).orderBy("unit_no").collect()] == [4, 4, 4]


def test_grading(spark):
    rows = spark.createDataFrame([("I considered (A) then chose (D)",)], "answer string")
    r = assessment.objective(rows, "answer", F.lit("D")).first()
    assert (r.chosen, r.verdict, r.confidence, r.needs_review) == ("A", "noCredit", 0.5, True)
    points = F.array(F.struct(F.lit("force").alias("keyword"), F.lit(1).cast("long").alias("marks")))
    r = assessment.graded(spark.createDataFrame([("Not attempted.",)], "answer string"), "answer", points, F.lit(1)).first()
    assert (r.verdict, r.awarded, r.needs_review) == ("blank", 0, False)


def test_near_duplicates(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:7], "india"])), (3, "something else that is quite different here")], "id int, text string")
    pairs = assessment.near_pairs(rows, "text", "id")
    assert [(r.a, r.b, round(r.similarity, 4)) for r in pairs.collect()] == [(1, 2, 0.7778)]
    assert {r.id: r.accepted for r in assessment.greedy(pairs).collect()} == {1: True, 2: False}


def test_every_row_is_accepted_or_not(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    texts = [" ".join(words), " ".join(reversed(words)), " ".join([*words[:7], "india"]), " ".join(["india", *words[:7]]), "quite different words stand here", "Quite different: words stand here!", "two words", "two words", None]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    assert sorted(map(tuple, assessment.near_accepted(rows, "text", "id").collect())) == [(1, 1, True), (2, 1, False), (3, 3, False), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True), (9, 9, True)]


def test_near_dup_greedy_is_the_pass_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    taken, want, classes = [], {}, {}
    for r in sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()):
        mine = frozenset(re.findall(r"[a-z][a-z0-9-]+", (r.text or "").lower())) - set(X.CONTENT_STOP)
        small = len(mine) < 4
        want[r.doc_id] = small or not any(len(mine & x) >= 0.75 * len(mine | x) for x in taken)
        taken += [mine] if want[r.doc_id] and not small else []
        classes[r.doc_id] = r.doc_id if small else classes.get(mine, r.doc_id)
        classes.setdefault(mine, r.doc_id)
    classes = {k: v for k, v in classes.items() if not isinstance(k, frozenset)}
    got = suite.QUERIES["near_dup_greedy"](spark, d).collect()
    assert len(got) == len(want) and {r.id: r.accepted for r in got} == want and {r.id: r["class"] for r in got} == classes
    assert {r.id: r["class"] for r in suite.QUERIES["near_dup_classes"](spark, d).collect()} == classes


def test_greedy_is_one_pass(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 6), (2, 6)]
    kept = []
    for n in range(1, 7):
        if not any((min(n, k), max(n, k)) in pairs for k in kept):
            kept.append(n)
    got = assessment.greedy(spark.createDataFrame(pairs, "a int, b int")).where("accepted").collect()
    assert sorted(r.id for r in got) == kept


def test_greedy_decides_long_chains(spark):
    chain = spark.range(70).selectExpr("id AS a", "id + 1 AS b").coalesce(1)
    assert {r.id: r.accepted for r in assessment.greedy(chain).collect()} == {i: i % 2 == 0 for i in range(71)}


def test_levels_of_a_long_chain(spark):
    chain = spark.range(66).selectExpr("string(id) AS source", "string(id + 1) AS target").coalesce(1)
    assert {r.id: r.level for r in graph.levels(chain).collect()} == {str(i): i for i in range(67)}


HINDI = "\u092a\u094d\u0930\u0915\u093e\u0936 \u0915\u093e"

FLAGS = [
    # text, mangled, broken_options, broken_fractions, non_latin; by hand from the reference's rules
    ("The plain question of ten words stands here without any", False, False, False, False),
    ("a fine long word after another word then some $igil stands", True, False, False, False),  # 1 sigil of 58, 1 token of 11
    ("a fine long word after another word then some more words and then $igil stands", False, False, False, False),  # 1 token of 15
    (HINDI, True, False, False, True),
    ("what is called light here in this text of mine " + HINDI, False, False, False, False),  # 5 letters of 43
    ("light " + HINDI, True, False, False, True),
    ("one of (A) first (B) second (C) third (D) .", False, True, False, False),
    ("one of (A) first (B) ; (C) third", False, True, False, False),
    ("one of (A) first (B) second (C) third (D) x2", False, False, False, False),
    ("(a) first OR", False, False, False, False),
    ("(a)", False, False, False, False),
    ("one (a)\n50\n 3 \n(b) 20", False, False, True, False),
    ("one (a)\r\n50\r\n3000\n(b) 20", False, False, False, False),
    ("one\n50\n3\n", False, False, False, False),
]


def test_encoding_flags(spark, tmp_path):
    spark.createDataFrame([(i, r[0]) for i, r in enumerate(FLAGS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suite.QUERIES["encoding_flags"](spark, str(tmp_path)).collect()}
    for i, r in enumerate(FLAGS):
        assert (r[0], got[i].mangled, got[i].broken_options, got[i].broken_fractions, got[i].non_latin) == r
    texts = spark.createDataFrame([("light " + HINDI,), ("light ???",), ("light",)], "t string")
    assert [r[0] for r in texts.select(X.ocr_flags(F.col("t"))).collect()] == [["mixed_script"], ["unresolved"], []]
    labels = ["Ohm", "cm", "m", " m ", "sun's", "12.5", "caf\u00e9", "9 V", "x\n", "", None]
    got = spark.createDataFrame([(x,) for x in labels], "t string").select("t", X.clean_label(F.col("t")).alias("ok")).collect()
    assert [r.t for r in got if r.ok] == ["Ohm", "cm", "9 V"]


def test_graph(spark):
    chain = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "source string, target string, occurrences int")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.neighbours(chain, start, 2).collect()} == {"b": 1, "c": 2}
    square = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d")], "source string, target string")
    assert sorted(r.path for r in graph.paths(square, "a", "d", 4).collect()) == ["a>b>d", "a>c>d"]
    assert {r.id: r.level for r in graph.levels(square).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_vote_edges(spark):
    voted = spark.createDataFrame([("x", "y", 0.428571, 5, 2)], "prerequisite string, concept string, score double, weight long, against long")
    d = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "label string, difficulty double")
    r = curriculum.edges(voted, d, 14).first()
    assert (round(r.confidence, 4), r.spacing_days) == (0.3571, 10)


def test_segments(spark):
    pages = spark.createDataFrame([("s", 1, "1. alpha\n2) beta"), ("s", 2, "gamma")], "doc string, page int, text string")
    assert {r.question: r.text for r in assessment.segments(pages, "doc", "page", "text").collect()} == {1: "alpha", 2: "beta\ngamma"}


def test_text_metrics(spark):
    df = spark.createDataFrame([("a b c d", "a c d"), ("", ""), ("a", "")], "r string, c string")
    got = [(round(x.f, 4), round(x.l, 4), round(x.b, 4)) for x in df.select(X.token_f1(F.col("r"), F.col("c")).alias("f"), X.lcs_f1(F.col("r"), F.col("c")).alias("l"), X.bleu1(F.col("r"), F.col("c")).alias("b")).collect()]
    assert got == [(0.8571, 0.8571, round(2.718281828459045 ** (1 - 4 / 3), 4)), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
