"""Mapping, schemes, evidence, sessions and layout on small tables."""

from pyspark.sql import functions as F

from scholia.operators import workflow


def test_options_terms_scheme(spark):
    df = spark.createDataFrame([("Which metal floats? (A) iron ; (B)  sodium  metal (C) lead (D) zinc.", 5)], "stem string, marks int")
    r = df.select(workflow.options(F.col("stem")).alias("o"), workflow.terms(F.col("stem"), 3).alias("t"), workflow.scheme(F.array(F.lit("a"), F.lit("b")), F.col("marks")).alias("s")).first()
    assert r.o == {"A": "iron", "B": "sodium metal", "C": "lead", "D": "zinc"}
    assert r.t == ["metal", "floats"]
    assert [(p.keyword, p.marks) for p in r.s] == [("a", 3), ("b", 2)]


def test_evidence(spark):
    rows = [("d", 0.9, "exactly this part", "It says Exactly  this part here"), ("", 0.9, "x", "x"), (None, None, None, None), ("d", 0.2, "short", "short")]
    got = [(r.reason, r.quoted) for r in workflow.evidence_gate(spark.createDataFrame(rows, "document_id string, confidence double, snippet string, source_text string")).collect()]
    assert got == [("ok", True), ("missing document_id", False), ("no provenance", False), ("confidence below 0.5", False)]


def test_sessions(spark):
    printed = spark.createDataFrame([("s", 1, 10), ("s", 2, 11), ("s", 3, 99), ("t", 1, 10)], "session string, number int, question_id int")
    bank = spark.createDataFrame([(10, "q"), (11, "r")], "id int, stem string")
    segments = spark.createDataFrame([("s", 1, "answer")], "session string, number int, answer string")
    failed = spark.createDataFrame([("s",)], "session string")
    got = {(r.session, r.number): r.state for r in workflow.sessions(printed, bank, segments, failed).collect()}
    assert got == {("s", 1): "answered", ("s", 2): "review", ("s", 3): "noMatch", ("t", 1): "blank"}


def test_tables_and_text(spark):
    spans = [(1, x, 10.0 + y, f"c{i}") for i, (x, y) in enumerate([(0.0, 0.0), (50.0, 1.0), (100.0, 0.5)])] + [(1, 0.0, 40.0, "alone")]
    assert [r.text for r in workflow.table_rows(spark.createDataFrame(spans, "page int, x double, y double, text string")).collect()] == ["c0 | c1 | c2"]
    r = spark.createDataFrame([("good\n\nI see an image of a page\n\nalso good",)], "t string").select(workflow.without_paragraphs(F.col("t"), ("i see an image",)).alias("t")).first()
    assert r.t == "good\n\nalso good"
    r = spark.createDataFrame([('text ```json\n{"a": 1}\n``` end',), ("no json",), ('x [1, 2] y',)], "t string").select(workflow.json_of(F.col("t")).alias("j")).collect()
    assert [x.j for x in r] == ['{"a": 1}', None, "[1, 2]"]
    r = spark.range(1).select(workflow.merged_beliefs(F.array(F.lit("force keeps motion going")), F.array(F.lit("force keeps motion going on"), F.lit("heavy things fall faster"))).alias("m")).first()
    assert r.m == ["force keeps motion going", "heavy things fall faster"]
