"""File sources and streams."""

import json

from pyspark.sql import functions as F

from joins import rows_of_joins
from scholia.sources import files
from scholia.streaming import replay


def test_corpus(spark, tmp_path):
    (tmp_path / "X").mkdir()
    (tmp_path / "X" / "Science_086_marking 2024.pdf").write_bytes(b"%PDF" + b"x" * 3000)
    (tmp_path / "copy of scheme.pdf").write_bytes(b"%PDF" + b"x" * 3000)
    (tmp_path / "small.pdf").write_bytes(b"<html>not found</html>")
    (tmp_path / ".hidden.pdf").write_bytes(b"x" * 100)
    rows = {r.name: r for r in files.deduplicated(files.problems(files.corpus(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"Science_086_marking 2024.pdf", "copy of scheme.pdf", "small.pdf"}
    assert rows["Science_086_marking 2024.pdf"].kind == "marking_scheme" and rows["Science_086_marking 2024.pdf"].year == "2024"
    assert rows["Science_086_marking 2024.pdf"].problems == [] and rows["small.pdf"].problems == ["small pdf", "html error page", "no pdf magic"]
    assert rows["copy of scheme.pdf"].duplicate_of == rows["copy of scheme.pdf"].source_id and rows["Science_086_marking 2024.pdf"].duplicate_of is None


def test_paths(spark):
    r = spark.createDataFrame([("/data/2025/X/086_Science_x.pdf", "Paper 31 - 1 - 2")], "p string, t string").select(files.subject_of_path(F.col("p")).alias("s"), files.grade_of_path(F.col("p")).alias("g"), files.paper_code(F.col("t")).alias("c")).first()
    assert (r.s, r.g, r.c) == ("Science", "X", "31/1/2")


def test_json_lines_and_syllabus(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"question": "What is x?", "n": 1}\nbroken\n{"question": "what is  X?", "n": 2}\n')
    maps = files.json_lines(spark, str(tmp_path / "m.jsonl"), "question string, n int")
    assert [r.n for r in files.latest_maps(maps.where("n IS NOT NULL"), "n").collect()] == [1]
    (tmp_path / "s.json").write_text(json.dumps({"subject": "Science", "grade": 10, "total_marks": 80, "units": [{"unit_no": 1, "name": "A", "marks": 50, "chapters": [{"id": "a1", "name": "A1"}]}, {"unit_no": 2, "name": "B", "marks": 30, "chapters": []}]}))
    assert [(r.chapter_id, r.chapter) for r in files.syllabus(spark, str(tmp_path / "s.json")).orderBy("unit_no").collect()] == [("a1", "A1"), ("unit-2", "B")]


def test_answer_keys(spark):
    pages = spark.createDataFrame([("f", 1, "Code 31/1/1\nintro 1. D\nSECTION A\n1. (B) energy\n2. C heat\n"), ("f", 2, "3) A x\n1. C again")], "path string, page int, text string")
    got = {(r.paper_code, r.q_no): r.option for r in files.answer_keys(pages).collect()}
    assert got == {("31/1/1", 1): "B", ("31/1/1", 2): "C", ("31/1/1", 3): "A"}


def test_keys_that_say_the_same_are_joined_once(spark):
    columns = "subject string, grade string, paper_code string, q_no int"
    keys = spark.createDataFrame([("Science", g, "31/1/1", 1, o) for g, o in [("X", "B"), ("X", "A"), ("", "D"), ("X", None), (None, "C")] * 40], f"{columns}, option string")
    asked = spark.createDataFrame([(i, "Science", g, "31/1/1", q) for i, (g, q) in enumerate([("X", 1), ("XII", 1), (None, 1), ("X", 2)] * 10)], f"id int, {columns}")
    found = files.looked_up(asked, keys)
    assert {(r.id % 4, r.option) for r in found.collect()} == {(0, "B"), (1, "D"), (2, "D"), (3, None)} and found.count() == 40
    assert rows_of_joins(files.looked_up(asked, keys)) == 50  # 5 from each four questions: their own grade's key and the one without a grade


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, i, f"c{i % 3}", "answer", float(i % 2), None) for i in range(20)]
    df = spark.createDataFrame(rows, "learner_id long, event_id long, concept_id string, kind string, outcome double, affect string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = replay.read(spark, str(tmp_path / "in"), files_a_batch=1)
    q = replay.to_table(replay.replayed(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted(map(tuple, replay.current(spark, str(tmp_path / "out"), ["learner_id", "concept_id"]).collect()))
    assert got == sorted(map(tuple, replay.replayed(df).collect()))
