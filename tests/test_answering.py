"""Answers from hits, against what a plain reading of small tables gives; the queries are held against SQL in test_suite."""

import random

from scholia.operators import answering, curriculum, stores

CHUNKS = [(f"{d}:{i}", d, 1 + i // 2, h, t) for d, h in ((1, "marking scheme"), (2, "unit one"), (3, None)) for i, t in enumerate(("light bends", "light is a wave", None, "x" * 900))]


def tables(spark, hits, doubts):
    return (
        spark.createDataFrame(hits, "query_id int, id string, rank long"), spark.createDataFrame(doubts, "query_id int, query string"),
        spark.createDataFrame(CHUNKS, "id string, document_id int, page int, heading string, text string"),
    )


def test_answer_quotes_three_and_cites_eight(spark):
    hits = [(1, f"{d}:{i}", 4 * k + i + 1) for k, d in enumerate((2, 1, 3)) for i in range(4)]
    out = {r.query_id: r for r in answering.solved(*tables(spark, hits, [(1, "light"), (2, "nothing"), (3, None)])).collect()}
    assert out[1].answer == "[1] (2 p.1) light bends\n\n[2] (2 p.1) light is a wave\n\n[3] (2 p.2) "
    assert out[1].citations.split("; ") == ["2 p.1 unit one"] * 2 + ["2 p.2 unit one"] * 2 + ["1 p.1 marking scheme"] * 2 + ["1 p.2 marking scheme"] * 2
    assert (out[1].evidence, out[1].cited) == ("2 p.1; 2 p.1; 2 p.2; 2 p.2; 1 p.1", 8)
    assert [tuple(out[i])[1:] for i in (2, 3)] == [(answering.NOTHING, "", "", 0)] * 2


def test_a_quotation_has_400_characters(spark):
    got = answering.solved(*tables(spark, [(1, "2:3", 1)], [(1, "x")])).first()
    assert got.answer == "[1] (2 p.2) " + "x" * 400


def test_critic_chooses_and_neutral_verdicts(spark):
    hits, doubts, chunks = tables(spark, [(q, f"2:{i}", i + 1) for q in (1, 2, 3) for i in range(4)], [(1, "a"), (2, "b"), (3, "c"), (4, "d")])
    verdicts = spark.createDataFrame([(1, "2:0", True, "none", 1), (1, "2:1", True, "FULL", 5), (1, "2:3", True, "full", 5), (2, "2:2", True, "odd", 9), (2, "2:0", None, None, None)], "query_id int, id string, relevant boolean, support string, utility int")
    needed = spark.createDataFrame([(3, False), (1, None)], "query_id int, retrieve boolean")
    got = {r.query_id: tuple(r)[1:] for r in answering.reflected(hits, doubts, chunks, verdicts, needed).collect()}
    assert got[1] == ("answered", 2, 1, 2.5, "2 p.1 2.500; 2 p.2 1.000; 2 p.1 0.500", "[2 p.1] light is a wave")  # the fourth hit is no path
    assert got[2][:5] == ("answered", 2, 1, 1.0, "2 p.1 1.000; 2 p.2 1.000; 2 p.1 0.000")
    assert got[3] == ("needless", None, None, None, "", answering.NEEDLESS)
    assert got[4] == ("nothing", None, None, None, "", answering.NOTHING)


def test_lexical_verdicts(spark):
    got = answering.lexical_verdicts(*tables(spark, [(1, f"2:{i}", i + 1) for i in range(4)], [(1, "what is a light wave")])).collect()
    assert sorted((r.id, r.relevant, r.support, r.utility) for r in got) == [("2:0", True, "partial", 2), ("2:1", True, "full", 3), ("2:2", False, "none", 1)]


def test_schemes_come_first_or_all_stay(spark):
    hits, _, chunks = tables(spark, [(1, "2:0", 1), (1, "1:0", 2), (1, "3:0", 3), (1, "1:1", 4), (2, "2:0", 1), (2, "3:1", 2)], [])
    got = sorted((r.query_id, r.rank, r.id) for r in answering.schemes(hits, chunks).collect())
    assert got == [(1, 1, "1:0"), (1, 2, "1:1"), (2, 1, "2:0"), (2, 2, "3:1")]
    assert answering.schemes(hits, chunks, most=1).count() == 2


def test_sections_by_heading(spark):
    hits, _, chunks = tables(spark, [(1, "2:3", 1), (1, "1:0", 2), (1, "3:0", 3), (1, "2:0", 4), (1, "2:2", 5)], [])
    got = [tuple(r) for r in answering.sections(hits, chunks).orderBy("place").collect()]
    assert got == [(1, "unit one", 1, 3, "x" * 120 + " | light bends | "), (1, "marking scheme", 2, 1, "light bends")]
    assert answering.sections(hits.limit(0), chunks).count() == 0


def test_grade_prerequisites_equal_plain_pairs(spark):
    rng = random.Random(5)
    found = [(f"l{rng.randrange(9)}", rng.randrange(40)) for _ in range(80)]
    grades = {d: rng.choice((None, 3, 4, 6, 7)) for d in range(35)}
    met = {}
    for label, d in found:
        if grades.get(d) is not None:
            met.setdefault(label, set()).add(grades[d])
    want = {(a, b): sum(g < h for g in met[a] for h in met[b]) for a in met for b in met if min(met[a]) < min(met[b])}
    got = curriculum.grade_prerequisites(spark.createDataFrame(found, "label string, document_id int"), spark.createDataFrame(list(grades.items()), "document_id int, grade int"))
    assert want and {(r.prerequisite, r.concept): r.n for r in got.collect()} == want
    none = spark.createDataFrame([], "document_id int, grade int")
    assert curriculum.grade_prerequisites(spark.createDataFrame(found, "label string, document_id int"), none).count() == 0


def test_page_links_of_titles_and_anchors(spark):
    pages = [("<title>The law</title><a href='/x'>of it</a><a href=\"/y\">The</a><a href=/z>other</a>",), ("<title></title><a href='/'>of</a>",), (None,), ("<title>OF</title><a href='/'>AND</a><a href='/'>and</a>",)]
    labels = spark.createDataFrame([("the",), ("of",), ("and",)], "label string")
    got = curriculum.page_links(spark.createDataFrame(pages, "html string"), "html", labels)
    assert sorted(map(tuple, got.collect())) == [("of", "and"), ("the", "of")]


def test_told_edges_gather_predicates(spark):
    told = spark.createDataFrame([("a", "needs", "b", 2), ("a", "is", "b", 1), ("a", "is", "z", 1)], "subject string, predicate string, object string, n long")
    got = curriculum.told_edges(told, spark.createDataFrame([("a",), ("b",)], "label string")).collect()
    assert [(r.source, r.target, r.predicates, r.type, r.span) for r in got] == [("a", "b", ["is", "needs"], "RELATED_TO", None)]


def test_next_row_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice((None, *range(60))), rng.choice((None, "a", "b", "c"))) for _ in range(200)]
    plain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = sorted(((*r, n[1], True) for r, n in zip(plain, plain[1:])), key=repr) + [(*plain[-1], None, False)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    got = stores.with_next(df, "k", "v", "other")
    assert sorted((tuple(r) for r in got.select("k", "v", "other", "followed").collect()), key=repr) == sorted(want, key=repr)
    assert stores.with_next(df.limit(0), "k", "v", "other").count() == 0
    assert [tuple(r) for r in stores.with_next(df.limit(1).select("k", "v"), "k", "v", "other").select("other", "followed").collect()] == [(None, False)]
