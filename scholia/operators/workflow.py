"""Mapping raw questions to a bank, schemes, evidence, sessions, practice and study plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import scales
from scholia.functions import text as X

# Words that are kept as terms although short, and words that are no terms.
SHORT_TERMS = ("ph", "dna", "rna", "atp", "emf", "co2", "h2o", "o2")
# Bounds of question numbers by section, and the marks of each.
POSITION_MARKS = ((20, 1), (26, 2), (33, 3), (36, 5))
OPTION = r"\(([A-D])\)\s*(.*?)(?=\s*\([A-D]\)|$)"


def bank_rows(raw: DataFrame) -> DataFrame:
    """Questions of a bank from raw ones (id, q_no, marks, bloom, chapter, confidence, grade): plausible marks or those of the position, Bloom, difficulty, type, quality."""
    number = F.try_to_number(F.trim("q_no"), F.lit("999")).cast("int")
    by_place = F.lit(4)
    for bound, marks in reversed(POSITION_MARKS):
        by_place = F.when(number <= bound, marks).otherwise(by_place)
    marks = F.when((F.col("marks") >= 1) & (F.col("marks") < 11), F.floor("marks")).otherwise(F.when(number.isNull(), 1).otherwise(by_place)).cast("long")
    bloom = F.when(F.col("bloom").isin(*scales.BLOOM), F.col("bloom")).otherwise("understand")
    mapped = raw.withColumns({"marks": marks, "bloom": bloom})
    band = F.when(F.col("marks") <= 2, 0).when(F.col("marks") == 3, 1).otherwise(2) + F.when(F.col("bloom") == "remember", -1).when(F.col("bloom").isin("analyze", "evaluate", "create"), 1).otherwise(0)
    m = F.col("marks")
    return mapped.select(
        "id", "chapter", "marks", "bloom", F.when(band <= 0, "easy").when(band == 1, "medium").otherwise("hard").alias("difficulty"), F.when(m <= 1, "very_short_answer").when(m == 2, "short_answer").when(m <= 4, "long_answer").otherwise("case_study").alias("type"),
        F.greatest(F.lit(1), m * 2).cast("long").alias("minutes"), F.round(0.6 + 0.3 * F.col("confidence"), 2).alias("quality"), F.when(F.upper(F.trim("grade")) == "XII", 12).when(F.upper(F.trim("grade")) == "XI", 11).when(F.upper(F.trim("grade")) == "IX", 9).otherwise(10).alias("grade"),
    )


def options(stem: Column) -> Column:
    """Label to text of the options (A) to (D) in a stem."""
    labels = F.regexp_extract_all(stem, F.lit(OPTION), F.lit(1))
    bodies = F.transform(F.regexp_extract_all(stem, F.lit(OPTION), F.lit(2)), lambda b: F.btrim(F.regexp_replace(b, r"\s+", " "), F.lit(" .;")))
    return F.map_from_arrays(labels, bodies)


def terms(stem: Column, n: int) -> Column:
    """Content words of a stem without its options, each once, at most n; `key idea` without any."""
    body = F.regexp_replace(stem, r"\([A-D]\)[^(]*", " ")
    found = F.regexp_extract_all(F.lower(body), F.lit("([a-z][a-z0-9-]+)"), F.lit(1))
    kept = F.array_distinct(F.filter(found, lambda w: ~w.isin(*X.CONTENT_STOP) & ((F.length(w) > 3) | w.isin(*SHORT_TERMS))))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, n)).otherwise(F.array(F.lit("key idea")))


def scheme(points: Column, marks: Column) -> Column:
    """Marking points with whole marks that sum to the marks: an equal share each, one more for the first ones."""
    n = F.greatest(F.size(points), F.lit(1))
    return F.transform(points, lambda p, i: F.struct(p.alias("keyword"), (F.floor(marks / n) + F.when(i < marks % n, 1).otherwise(0)).cast("long").alias("marks")))


def synonyms(term: Column) -> Column:
    """Variants of a term that count as it: its plural or singular, and the longer words of a phrase; in order."""
    t = F.lower(term)
    found = F.array_compact(F.array(F.when(F.endswith(t, F.lit("y")), F.concat(F.substr(t, F.lit(1), F.length(t) - 1), F.lit("ies"))), F.when(~F.endswith(t, F.lit("s")), F.concat(t, F.lit("s"))), F.when(F.endswith(t, F.lit("s")) & (F.length(t) > 3), F.substr(t, F.lit(1), F.length(t) - 1))))
    parts = F.when(F.contains(t, F.lit(" ")), F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(found, parts), lambda w: w != t)))


def answer_schemes(questions: DataFrame) -> DataFrame:
    """id, objective, points (keyword, marks, required, synonyms) of questions (id, stem, type, marks, option, value_points).

    An objective question has one point, its correct option. Else official value points share the marks, the first ones one more; without any, the stem's terms have
    one mark each, the first one what is left.
    """
    marks = F.greatest(F.lit(1), F.col("marks")).cast("long")
    known = options(F.col("stem"))
    point = lambda keyword, worth, required, others: F.struct(keyword.alias("keyword"), worth.cast("long").alias("marks"), required.alias("required"), others.alias("synonyms"))
    none = F.array().cast("array<string>")
    given = F.filter(F.coalesce("value_points", none), lambda v: F.trim(v) != "")
    rows = questions.select("id", (F.size(known) > 0) | F.coalesce(F.col("type").isin("mcq", "assertion_reason"), F.lit(False)), marks, known, given, terms(F.col("stem"), 99), "option").toDF("id", "objective", "marks", "options", "given", "terms", "option")
    chosen = F.coalesce(F.try_element_at("options", F.col("option")), "option", F.lit(""))
    right = F.array(point(chosen, F.col("marks"), F.lit(True), F.when(F.col("option").isNotNull(), F.array("option")).otherwise(none)))
    n = F.greatest(F.size("given"), F.lit(1))
    official = F.transform("given", lambda v, i: point(F.coalesce(F.get(F.split(F.trim(v), r"\s+"), F.lit(0)), v), F.floor(F.col("marks") / n) + F.when(i < F.col("marks") % n, 1).otherwise(0), i == 0, none))
    own = F.slice("terms", F.lit(1), F.col("marks").cast("int"))
    guessed = F.transform(own, lambda t, i: point(t, F.when(i == 0, 1 + F.col("marks") - F.size(own)).otherwise(1), i == 0, synonyms(t)))
    return rows.select("id", "objective", F.when(F.col("objective"), right).when(F.size("given") > 0, official).otherwise(guessed).alias("points"))


def evidence_gate(rows: DataFrame) -> DataFrame:
    """Rows (document_id, confidence, snippet, source_text) with reason and whether the snippet stands in its source."""
    reason = F.when(F.col("document_id").isNull() & F.col("confidence").isNull(), "no provenance").when(F.coalesce("document_id", F.lit("")) == "", "missing document_id").when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "confidence below 0.5").otherwise("ok")
    quoted = (F.length("snippet") >= 8) & F.contains(X.normalized(F.col("source_text")), X.normalized(F.col("snippet")))
    return rows.withColumns({"reason": reason, "quoted": F.coalesce(quoted, F.lit(False))})


def without_paragraphs(text: Column, markers: tuple[str, ...]) -> Column:
    """The text without the paragraphs that hold a marker."""
    return F.trim(F.array_join(F.filter(F.split(text, "\n\n"), lambda b: ~X.holds_any(F.lower(b), markers)), "\n\n"))


def sessions(printed: DataFrame, bank: DataFrame, segments: DataFrame, failed: DataFrame) -> DataFrame:
    """Review items of scan sessions: printed (session, number, question_id) with the bank's question and the answer's segment.

    A question that the bank lacks is `noMatch`; a missing answer in a session with a failed page goes to review.
    """
    joined = printed.join(bank.select(F.col("id").alias("question_id"), "stem"), "question_id", "left").join(segments, ["session", "number"], "left").join(failed.select("session", F.lit(True).alias("failed")).distinct(), "session", "left")
    state = F.when(F.col("stem").isNull(), "noMatch").when(F.col("answer").isNull() & F.coalesce("failed", F.lit(False)), "review").when(F.col("answer").isNull(), "blank").otherwise("answered")
    return joined.select("session", "number", "question_id", "answer", state.alias("state"))


def extraction_accuracy(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Share of gold rows (id) whose predicted row has equal keys, null equal to null."""
    p = predicted.select(F.col("id").alias("__id"), *[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    right = gold.join(p, gold.id == F.col("__id")).where(same).agg(F.count_distinct("id").alias("right"))
    return gold.agg(F.count("*").alias("n")).crossJoin(right).select("n", "right", F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0).alias("accuracy"))  # one row each


def concept_matches(questions: DataFrame, concepts: DataFrame, least: float = 0.18) -> DataFrame:
    """question_id, concept, score of concepts whose words have at least that Jaccard similarity with a question's, by an equi-join on words."""
    q = questions.select("question_id", X.words(F.col("question")).alias("ws")).withColumn("nq", F.size("ws")).select("question_id", "nq", F.explode("ws").alias("w"))
    c = concepts.select("concept", X.words(F.col("concept")).alias("ws")).withColumn("nc", F.size("ws")).select("concept", "nc", F.explode("ws").alias("w"))
    both = q.join(c, "w").groupBy("question_id", "concept", "nq", "nc").agg(F.count("*").alias("i"))
    score = F.col("i") / (F.col("nq") + F.col("nc") - F.col("i"))
    return both.select("question_id", "concept", score.alias("score")).where(F.col("score") >= least)


def evidence_events(answers: DataFrame) -> DataFrame:
    """Learner events from graded answers (student, question_id, chapters, awarded, max_marks, difficulty, t_us): one for each chapter."""
    ease = F.when(F.col("difficulty") == "easy", 0.3).when(F.col("difficulty") == "medium", 0.6).otherwise(0.9)
    return answers.select(F.col("student").alias("learner_id"), F.explode("chapters").alias("concept_id"), F.lit("answer").alias("kind"), (F.col("awarded") / F.col("max_marks")).alias("outcome"), ease.alias("difficulty"), "t_us")


def practice_result(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of mastery by a practice: learner_id, concept_id, before, after, delta and what to do next."""
    b, a = before.select("learner_id", "concept_id", F.col("mastery").alias("before")), after.select("learner_id", "concept_id", F.col("mastery").alias("after"))
    joined = a.join(b, ["learner_id", "concept_id"], "left").fillna(0.0, ["before"])
    action = F.when(F.col("after") >= 0.85, "advance").when(F.col("after") > F.col("before"), "continue").otherwise("reteach")
    return joined.select("learner_id", "concept_id", "before", "after", (F.col("after") - F.col("before")).alias("delta"), action.alias("action"))


def study_plan(steps: DataFrame, retention: DataFrame, capacity: int = 120, each: int = 20) -> DataFrame:
    """Each learner's steps of a plan (id, level) in order, with what to do and whether they fit today: learn, retrieve under 0.6, skip above.

    steps: a curriculum's, scales.MOST_FEW at most. retention: learner_id, concept_id, retention; its learners are the plan's.
    """
    listed = scales.few(steps).agg(F.collect_list(F.struct("level", "id")).alias("steps"))
    learners = retention.select("learner_id").distinct().crossJoin(F.broadcast(listed)).select("learner_id", F.explode("steps").alias("x")).select("learner_id", "x.*")  # one row
    joined = learners.join(retention.select("learner_id", F.col("concept_id").alias("id"), "retention"), ["learner_id", "id"], "left")
    action = F.when(F.col("retention").isNull(), "learn").when(F.col("retention") < 0.6, "retrieve").otherwise("skip")
    minutes = F.when(F.col("action") == "skip", 0).otherwise(each)
    order = Window.partitionBy("learner_id").orderBy("level", "id").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("action", action).withColumn("minutes", minutes).withColumn("used", F.sum("minutes").over(order)).select("learner_id", "id", "level", "action", F.col("minutes").cast("long").alias("minutes"), (F.col("used") <= capacity).alias("today"))


def top_evidence(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n provenances of most confidence of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("confidence"), "document_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def merged_beliefs(known: Column, more: Column, most: float = 0.4) -> Column:
    """The known beliefs and those of the others that have a Jaccard similarity under `most` with all before."""
    toks = lambda b: F.array_distinct(X.tokens(b))
    return F.aggregate(more, known, lambda out, b: F.when(F.exists(out, lambda o: X.jaccard(toks(o), toks(b)) >= most), out).otherwise(F.concat(out, F.array(b))))


def table_rows(spans: DataFrame) -> DataFrame:
    """Rows of tables on pages: spans (page, x, y, text) clustered by y (gaps over 3), rows of three or more spans whose gaps are even and over 8."""
    order = Window.partitionBy("page").orderBy("y", "x")
    new = F.coalesce((F.col("y") - F.lag("y").over(order) > 3).cast("int"), F.lit(0))
    clustered = spans.withColumn("row", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = clustered.withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("page", "row").orderBy("x")))
    by = gaps.groupBy("page", "row").agg(F.count("*").alias("cells"), F.min("gap").alias("least"), F.avg("gap").alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), " | ").alias("text"))
    return by.where((F.col("cells") >= 3) & (F.col("least") > 8) & (F.col("least") >= 0.6 * F.col("mean"))).select("page", "row", "cells", "text")


def page_quality(pages: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Share of each document's pages that have text and no marker of made-up text."""
    good = (F.length(F.trim("text")) > 0) & ~X.holds_any(F.lower("text"), markers)
    return pages.groupBy("document_id").agg(F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("quality"), F.count("*").alias("pages"))


def status_changes(changes: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Changes (id, before, after) with whether they are allowed."""
    ok = F.lit(False)
    for before, after in allowed.items():
        ok = ok | ((F.col("before") == before) & F.col("after").isin(*after))
    return changes.withColumn("allowed", ok)


def reviewed_totals(items: DataFrame) -> DataFrame:
    """Totals of scan sessions (session, awarded, teacher, max_marks, state): the teacher's mark counts where there is one; open items by state."""
    return items.groupBy("session").agg(F.sum(F.coalesce("teacher", "awarded")).alias("awarded"), F.sum("max_marks").alias("max_marks"), F.count_if(F.col("state").isin("review", "noMatch") & F.col("teacher").isNull()).alias("open"))


def json_of(text: Column) -> Column:
    """The JSON object or array in a model's reply: a fenced block, else from the first brace to the last; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)([{\[].*[}\]])", 1))
    # the parser takes a value and ignores what follows: brackets outside strings have to pair up too
    bare = F.regexp_replace(body, r'"(\\.|[^"\\])*+"', "")
    n = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    return F.when(F.try_parse_json(body).isNotNull() & (n("{") == n("}")) & (n("[") == n("]")), F.regexp_replace(body, r"^\s+|\s+$", ""))


def nearest(marks: DataFrame, words: DataFrame) -> DataFrame:
    """page, line, x of each mark with the nearest word before and behind it on its line, by running values over both: an as-of join without a range join. words: page, line, x, word."""
    both = marks.select("page", "line", "x", F.lit(None).cast("string").alias("word"), F.lit(1).alias("mark")).unionByName(words.select("page", "line", "x", "word", F.lit(0).alias("mark")))
    order = Window.partitionBy("page", "line").orderBy("x", "mark", "word")
    back = Window.partitionBy("page", "line").orderBy(F.desc("x"), "mark", F.desc("word"))
    held = both.withColumns({"left": F.last("word", ignorenulls=True).over(order), "right": F.last("word", ignorenulls=True).over(back)})
    return held.where("mark = 1").select("page", "line", "x", "left", "right")


def contained(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """question_id, concept: the longest concept whose tokens stand in a row in the question (ties: the first by name)."""
    from scholia.operators import retrieval

    texts = questions.select(F.col("question_id").alias("id"), F.lit(0).alias("document_id"), F.lit(None).cast("string").alias("heading"), F.col("question").alias("text"))
    hits = retrieval.phrase_hits(texts, concepts.select(F.col("concept").alias("phrase")))
    best = Window.partitionBy("id").orderBy(F.desc(F.length("phrase")), "phrase")
    return hits.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("id").alias("question_id"), F.col("phrase").alias("concept"))
