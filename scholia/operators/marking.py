"""Rules that a grader's own marks of marking points, and edits of assessments, have to pass before they count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as X

# Below this a teacher looks; most confidence where the transcription is in doubt; confidence in a blank.
REVIEW, DOUBTFUL, BLANK = 0.75, 0.65, 0.95


def ruled(answers: DataFrame, said: DataFrame, points: DataFrame) -> DataFrame:
    """answer_id, awarded, omitted, verdict, confidence, needs_review of every answer.

    answers: answer_id, question_id, answer, max_marks, graded, confidence; said: answer_id, point_id, awarded, marks of the grader;
    points: question_id, point_id, marks of the scheme, one row a point. A point's marks stay within 0 and its scheme's (1 where the scheme
    lacks it); an awarded one without marks has them all; a point that the grader leaves out has none and is counted in omitted; the sum is at most
    max_marks. Blank answers have 0; answers without a grading have 0 and no confidence, and go to review. A point said twice counts twice.
    """
    most = F.coalesce("most", F.lit(1))
    given = F.coalesce("marks", F.when(F.col("awarded"), most).otherwise(0))
    scheme = points.select("question_id", "point_id", F.col("marks").alias("most"))
    told = said.join(answers.select("answer_id", "question_id"), "answer_id").join(scheme, ["question_id", "point_id"], "left")
    sums = told.groupBy("answer_id").agg(F.sum(F.greatest(F.lit(0), F.least(given, most))).alias("sum"), F.count_distinct(F.when(F.col("most").isNotNull(), F.col("point_id"))).alias("met"))
    listed = points.groupBy("question_id").agg(F.count("*").alias("listed"))
    rows = answers.join(listed, "question_id", "left").join(sums, "answer_id", "left")
    blank = ~F.coalesce("answer", F.lit("")).rlike(r"[\p{L}\p{N}]")
    graded = F.coalesce("graded", F.lit(False))
    doubtful = F.size(X.ocr_flags(F.coalesce("answer", F.lit("")))) > 0
    awarded = F.when(blank | ~graded, 0).otherwise(F.least(F.coalesce("sum", F.lit(0)), F.col("max_marks"))).cast("long")
    stated = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))), 2)
    sure = F.when(blank, BLANK).when(~graded, 0.0).when(doubtful, F.least(stated, F.lit(DOUBTFUL))).otherwise(stated)
    verdict = F.when(blank, "blank").when(~graded, "partialCredit").when(F.col("awarded") >= F.col("max_marks"), "fullCredit").when(F.col("awarded") > 0, "partialCredit").otherwise("noCredit")
    omitted = F.when(blank | ~graded, 0).otherwise(F.coalesce("listed", F.lit(0)) - F.coalesce("met", F.lit(0)))
    out = rows.withColumn("awarded", awarded).withColumn("confidence", sure)
    return out.select("answer_id", "awarded", omitted.cast("long").alias("omitted"), verdict.alias("verdict"), "confidence", (~blank & (~graded | (F.col("confidence") < REVIEW) | doubtful)).alias("needs_review"))


def edited(stored: DataFrame, edits: DataFrame, editable: tuple[str, ...]) -> DataFrame:
    """id, seq, status, accepted: what becomes of each edit (id, seq, status) of stored assessments (id, status).

    Edits apply in order of seq (ties: by status); each is accepted while the assessment's status is an editable one, which the edits before it may
    have changed: the first that leaves the editable ones locks all after it. An unknown id is a new assessment, its first edit accepted; so
    is one of null status. Edits of null ids are refused.
    """
    order = Window.partitionBy("id").orderBy("seq", "status")
    now = F.coalesce(F.col("held").isNull() | F.col("held").isin(*editable), F.lit(True))
    stays = F.coalesce(F.col("status").isin(*editable), F.lit(True))
    before = F.coalesce(F.min(stays).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    known = stored.select("id", F.col("status").alias("held"))
    return edits.select("id", "seq", "status").join(known, "id", "left").select("id", "seq", "status", (F.col("id").isNotNull() & now & before).alias("accepted"))


def papers(requests: DataFrame, selected: DataFrame, stored: DataFrame, editable: tuple[str, ...]) -> DataFrame:
    """paper_id, outcome, title, subject, grade, questions, marks, status of every request (paper_id, assessment_id) for a paper.

    selected: paper_id, position, subject, grade, marks, one row a question; stored: id, title, subject, grade, status of assessments. A paper without
    questions is refused as empty, one of a stored assessment that is not editable as locked; the others are generated, and status is that of
    their assessment from then on (null where none is stored). What an assessment doesn't say, the first question by position does (ties: by subject and
    grade). Requests don't see each other; questions of no request count nowhere; null marks are 0.
    """
    first = F.min(F.struct("position", "subject", "grade"))
    asked = selected.groupBy("paper_id").agg(F.count("*").alias("questions"), F.sum(F.coalesce("marks", F.lit(0))).cast("long").alias("marks"), first.alias("first"))
    known = stored.select(F.col("id").alias("assessment_id"), "title", "subject", "grade", "status", F.lit(True).alias("known"))
    rows = requests.select("paper_id", "assessment_id").join(asked, "paper_id", "left").join(known, "assessment_id", "left")
    locked = F.col("known") & ~F.coalesce(F.col("status").isin(*editable), F.lit(True))
    outcome = F.when(F.col("questions").isNull(), "empty").when(locked, "locked").otherwise("generated")
    made = lambda x: F.when(F.col("outcome") == "generated", x)
    return rows.withColumn("outcome", outcome).select(
        "paper_id", "outcome", made(F.coalesce("title", F.lit("Assessment"))).alias("title"), made(F.coalesce("subject", F.col("first")["subject"])).alias("subject"), made(F.coalesce("grade", F.col("first")["grade"])).alias("grade"),
        F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("marks", F.lit(0)).cast("long").alias("marks"), F.when(F.col("outcome") == "generated", F.when(F.col("known"), "paperGenerated")).otherwise(F.col("status")).alias("status"),
    )
