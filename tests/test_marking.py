from scholia.operators import marking

POINTS = [(1, "a", 2), (1, "b", 3), (2, "a", 1)]


def ruled(spark, answers, said):
    rows = spark.createDataFrame(answers, "answer_id int, question_id int, answer string, max_marks int, graded boolean, confidence double")
    told = spark.createDataFrame(said, "answer_id int, point_id string, awarded boolean, marks int")
    out = marking.ruled(rows, told, spark.createDataFrame(POINTS, "question_id int, point_id string, marks int"))
    return {r.answer_id: tuple(r)[1:] for r in out.collect()}


def test_marks_are_clamped_and_omitted_points_have_none(spark):
    answers = [(1, 1, "ray", 5, True, 0.9), (2, 1, "ray", 5, True, 1.7), (3, 1, "ray", 4, True, 0.9), (4, 2, "ray", 1, True, 0.9), (5, 9, "ray", 2, True, None), (6, 1, "ray", 5, True, 0.9)]
    said = [(1, "a", True, None), (1, "b", False, -4), (2, "a", True, 9), (3, "a", True, 2), (3, "b", True, 3), (4, "a", False, None), (5, "x", True, 7), (77, "a", True, 1)]
    assert ruled(spark, answers, said) == {
        1: (2, 0, "partialCredit", 0.9, False), 2: (2, 1, "partialCredit", 1.0, False), 3: (4, 0, "fullCredit", 0.9, False),
        4: (0, 0, "noCredit", 0.9, False), 5: (1, 0, "partialCredit", 0.5, True), 6: (0, 2, "noCredit", 0.9, False),
    }


def test_blank_ungraded_and_doubtful_answers(spark):
    answers = [(1, 1, " .?", 5, True, 0.1), (2, 1, None, 5, None, None), (3, 1, "ray", 5, False, 0.9), (4, 1, "it is 1234567 m", 5, True, 0.9), (5, 1, "ray", 5, None, 0.9)]
    said = [(i, "a", True, 2) for i in range(1, 6)]
    assert ruled(spark, answers, said) == {
        1: (0, 0, "blank", 0.95, False), 2: (0, 0, "blank", 0.95, False), 3: (0, 0, "partialCredit", 0.0, True),
        4: (2, 1, "partialCredit", 0.65, True), 5: (0, 0, "partialCredit", 0.0, True),
    }
    assert ruled(spark, [], said) == {}


def test_edits_are_refused_once_an_assessment_is_locked(spark):
    stored = spark.createDataFrame([(1, "draft"), (2, "approved"), (4, None)], "id int, status string")
    edits = spark.createDataFrame([(1, 1, "review"), (1, 2, "approved"), (1, 3, "draft"), (2, 1, "draft"), (3, 1, "approved"), (3, 2, "draft"), (4, 1, None), (4, 2, "draft"), (None, 1, "draft")], "id int, seq int, status string")
    got = {(r.id, r.seq): r.accepted for r in marking.edited(stored, edits, ("draft", "review")).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False, (3, 1): True, (3, 2): False, (4, 1): True, (4, 2): True, (None, 1): False}
    assert marking.edited(stored, edits.limit(0), ("draft",)).count() == 0


def test_papers_are_refused_when_empty_or_locked(spark):
    requests = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2), ("p4", 9), ("p5", None), ("p6", 3)], "paper_id string, assessment_id int")
    asked = [("p1", 2, "bio", 9, 3), ("p1", 1, "phy", 10, None), ("p3", 1, "phy", 10, 1), ("p4", 2, "geo", 7, 2), ("p4", 1, "art", 8, 4), ("p5", 1, None, None, 1), ("p6", 1, "bio", 9, 5), ("zz", 1, "bio", 9, 5)]
    selected = spark.createDataFrame(asked, "paper_id string, position int, subject string, grade int, marks int")
    stored = spark.createDataFrame([(1, "Term 1", None, 11, "draft"), (2, "Term 2", "phy", 10, "approved"), (3, None, "chem", None, None)], "id int, title string, subject string, grade int, status string")
    got = {r.paper_id: tuple(r)[1:] for r in marking.papers(requests, selected, stored, ("draft", "review")).collect()}
    assert got == {
        "p1": ("generated", "Term 1", "phy", 11, 2, 3, "paperGenerated"), "p2": ("empty", None, None, None, 0, 0, "draft"), "p3": ("locked", None, None, None, 1, 1, "approved"),
        "p4": ("generated", "Assessment", "art", 8, 2, 6, None), "p5": ("generated", "Assessment", None, None, 1, 1, None), "p6": ("generated", "Assessment", "chem", 9, 1, 5, "paperGenerated"),
    }
    assert marking.papers(requests.limit(0), selected, stored, ("draft",)).count() == 0
