"""Objects in page blocks (document_id, page, place, text): questions and their parts, marking points, blueprints, chunks under headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as X

# What begins a question or part, what states marks, what is a heading.
QUESTION, PART, MARKS = r"^[ \t]*([0-9]{1,3})[ \t]*[.)\]]", r"^[ \t]*\(([a-z])\)", r"(?i)\([ \t]*([0-9]+([.][0-9]+)?)[ \t]*(marks?)?[ \t]*\)"
HEADING = r"(?i)^[ \t]*(unit|chapter|lesson|module|section|topic|part)[ \t]*[0-9ivxl]+"
# What a block's text says about its place in the layout.
LAYOUT_HEADING = r"(?i)^[ \t]*(unit|chapter|lesson|module|section|topic|part)[ .\-:\t]*[0-9IVX]+"
LAYOUT_NUMBER, LAYOUT_LETTER = r"^[ \t]*([0-9]{1,3})[.|\-) \t][ \t]", r"^[ \t]*([a-z][.)\-])[ \t]"
LAYOUT_MARKS = r"(?i)\([ \t]*[0-9]+[ \t]*(marks?|×[ \t]*[0-9]+)?[ \t]*\)"
# Words of a question that tell its Bloom level, the first listed one first.
BLOOM_WORDS = (
    ("remember", "remember"), ("recall", "remember"), ("understand", "understand"), ("explain", "understand"), ("apply", "apply"), ("calculate", "apply"),
    ("analyze", "analyze"), ("compare", "analyze"), ("evaluate", "evaluate"), ("justify", "evaluate"), ("create", "create"), ("design", "create"),
)
# Labels that are no concepts, and beginnings of such.
GENERIC = (
    "process", "processes", "way", "ways", "thing", "things", "part", "parts", "whole", "example", "examples", "result", "results", "kind", "kinds", "type", "types", "number", "numbers", "amount", "amounts", "case", "cases",
    "side", "sides", "point", "points", "group", "groups", "set", "sets", "form", "forms", "method", "methods", "step", "steps", "value", "values", "unit", "units", "place", "places", "time", "times", "year", "years",
)
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
UNITS = ("cm", "mm", "km", "kg", "g", "mg", "ml", "l", "m", "s", "h", "min", "hrs", "sq")
NO_CONCEPT = ("q.", "ans", "answer ", "fig ", "figure ", "exercise", "chapter", "section")


def question_type(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *words: X.holds_any(low, words)
    return F.when(has("multiple choice", "mcq", "choose"), "mcq").when(has("case study", "passage"), "case_study").when(has("long", "essay"), "long_answer").when(has("short"), "short_answer").otherwise("unknown")


def question_bloom(text: Column) -> Column:
    """The Bloom level of the first listed word that a question holds, or null."""
    low, out = F.lower(text), F
    for word, level in BLOOM_WORDS:
        out = out.when(F.contains(low, F.lit(word)), level)
    return out


def meaningful(label: Column, stop: tuple[str, ...] = X.CONTENT_STOP) -> Column:
    """Whether a label can be a concept: 2 to 60 characters with a letter, no stop word, generic noun, Roman number, unit or reference."""
    low = F.trim(F.lower(label))
    begins = F.lit(False)
    for p in NO_CONCEPT:
        begins = begins | F.startswith(low, F.lit(p))
    return F.coalesce(F.length(low).between(2, 60) & low.rlike("[a-z]") & ~low.isin(*stop, *GENERIC, *ROMAN, *UNITS) & ~begins, F.lit(False))


def scorable(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Questions (id, type, stem, option) with whether they can be scored: with a key (id) or an option known, or not objective and without options in the stem."""
    known = keys.select("id", F.lit(True).alias("keyed")).distinct()
    objective = F.coalesce(F.col("type").isin("mcq", "assertion_reason"), F.lit(False)) | F.coalesce(F.col("stem").rlike(r"\([A-D]\)"), F.lit(False))
    return questions.join(known, "id", "left").withColumn("scorable", F.coalesce("keyed", F.lit(False)) | F.col("option").isNotNull() | ~objective).drop("keyed")


def _marks(text: Column) -> Column:
    return F.when(text.rlike(MARKS), F.regexp_extract(text, MARKS, 1).cast("double"))


def _questioned(blocks: DataFrame) -> DataFrame:
    """Blocks with the running number of the question that they belong to (0: before the first)."""
    rows = blocks.withColumn("text", F.trim("text")).where(F.col("text") != "")
    rows = rows.withColumn("q_no", F.when(F.col("text").rlike(QUESTION), F.regexp_extract("text", QUESTION, 1)))
    order = Window.partitionBy("document_id").orderBy("page", "place")
    return rows.withColumn("number", F.count("q_no").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def layout(blocks: DataFrame) -> DataFrame:
    """The blocks (document_id, page, place, text, kind, fontsize) with their kinds by text and size: headings, questions, lists.

    A numbered line is a list unless a heading or question comes right before it; whether that is so does not depend on lists, so the flag is a lag.
    """
    text, size = F.trim("text"), F.coalesce("fontsize", F.lit(0.0))
    page, order = Window.partitionBy("document_id", "page"), Window.partitionBy("document_id", "page").orderBy("place")
    sized = blocks.withColumn("most", F.max(size).over(page))
    large = (size > 0) & (size >= 0.85 * F.col("most")) & (F.length(text) < 140)
    upper = F.when(F.col("kind").isin("heading", "question"), F.col("kind")).when(text.rlike(LAYOUT_HEADING) | large, "heading").when(text.rlike(LAYOUT_NUMBER) & text.rlike(LAYOUT_MARKS), "question")
    told = sized.withColumn("upper", upper)
    behind = told.withColumn("behind", F.coalesce(F.lag(F.col("upper").isNotNull()).over(order), F.lit(False)))
    lists = (text.rlike(LAYOUT_NUMBER) & ~F.col("behind") & (F.length(text) < 160)) | (text.rlike(LAYOUT_LETTER) & (F.length(text) < 200))
    return behind.withColumn("kind", F.coalesce("upper", F.when(lists, "list").otherwise(F.col("kind")))).select(blocks.columns)


def questions(blocks: DataFrame) -> DataFrame:
    """document_id, number, q_no, marks, type, bloom, title, text, parts: a question begins at a number; what follows is its text, but for the parts (a), (b), ...

    Blocks before a document's first question belong to none; blank blocks don't count.
    """
    rows = _questioned(blocks).where("number > 0")
    is_part = F.col("q_no").isNull() & F.col("text").rlike(PART)
    first = F.max(F.when(F.col("q_no").isNotNull(), F.col("text")))
    said = F.array_sort(F.collect_list(F.when(~is_part, F.struct("page", "place", "text"))))
    by = rows.groupBy("document_id", "number").agg(F.max("q_no").alias("q_no"), first.alias("first"), said.alias("said"), F.count_if(is_part).alias("parts"))
    return by.select("document_id", "number", "q_no", _marks(F.col("first")).alias("marks"), question_type(F.col("first")).alias("type"), question_bloom(F.col("first")).alias("bloom"), F.substring("first", 1, 120).alias("title"), F.array_join(F.transform("said", lambda x: x["text"]), " ").alias("text"), "parts")


def parts(blocks: DataFrame) -> DataFrame:
    """document_id, number, q_no, part, text of the questions' parts."""
    rows = _questioned(blocks).where("number > 0")
    named = rows.withColumn("of", F.max("q_no").over(Window.partitionBy("document_id", "number")))
    return named.where(F.col("q_no").isNull() & F.col("text").rlike(PART)).select("document_id", "number", F.col("of").alias("q_no"), F.regexp_extract("text", PART, 1).alias("part"), "text")


def marking_points(blocks: DataFrame) -> DataFrame:
    """document_id, point, marks, detail: blocks that state marks, numbered in order."""
    rows = blocks.withColumn("text", F.trim("text")).withColumn("marks", _marks(F.col("text"))).where("marks IS NOT NULL")
    order = Window.partitionBy("document_id").orderBy("page", "place")
    return rows.select("document_id", F.row_number().over(order).cast("long").alias("point"), "marks", F.substring("text", 1, 400).alias("detail"))


def blueprints(pages: DataFrame) -> DataFrame:
    """document_id, page of pages (document_id, page, text) that hold the design of a paper."""
    low = F.lower("text")
    return pages.where(F.contains(low, F.lit("design of question paper")) | (F.contains(low, F.lit("blueprint")) & F.contains(low, F.lit("marks")))).select("document_id", "page")


def chunks(blocks: DataFrame, most: int = 4000) -> DataFrame:
    """document_id, page, chunk, heading, text, start, stop: blocks packed page by page under the headings met so far.

    A heading ends a chunk; so does a chunk of `most` characters, and a page. The path of headings grows to three of under 120 characters and never
    shrinks. start and stop count a document's characters without its headings, one more for each block.
    """
    rows = blocks.withColumn("text", F.trim("text")).where(F.col("text") != "").withColumn("is_heading", F.col("text").rlike(HEADING))
    order = Window.partitionBy("document_id").orderBy("page", "place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    path = F.slice(F.collect_list(F.when(F.col("is_heading") & (F.length("text") < 120), F.substring("text", 1, 80))).over(upto), 1, 3)
    rows = rows.withColumns({"path": F.array_join(path, " > "), "headings": F.count_if(F.col("is_heading")).over(upto), "stop": F.sum(F.when(~F.col("is_heading"), F.length("text") + 1).otherwise(0)).over(upto)})
    said = rows.where("NOT is_heading").withColumn("start", F.col("stop") - F.length("text") - 1)
    by = said.groupBy("document_id", "page", "headings", "path").agg(F.array_sort(F.collect_list(F.struct("place", "text", "start", "stop"))).alias("blocks"))
    # packing is a fold over a page's blocks under one heading: the characters so far, and the number of the pack of each block
    packed = F.expr(
        f"aggregate(blocks, struct(0 AS n, 0 AS pack, CAST(array() AS array<int>) AS packs), (s, b) -> IF(s.n + length(b.text) >= {most}, "
        "struct(0 AS n, s.pack + 1 AS pack, array_append(s.packs, s.pack) AS packs), struct(s.n + length(b.text) AS n, s.pack AS pack, array_append(s.packs, s.pack) AS packs)), s -> s.packs)"
    )
    each = by.select("document_id", "page", "headings", "path", F.explode(F.arrays_zip("blocks", packed.alias("packs"))).alias("x")).select("document_id", "page", "headings", F.col("path").alias("heading"), "x.blocks.*", F.col("x.packs").alias("pack"))
    made = each.groupBy("document_id", "page", "headings", "heading", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("start").alias("start"), (F.max("stop")).alias("stop"))
    numbered = Window.partitionBy("document_id").orderBy("start")
    return made.select("document_id", "page", F.row_number().over(numbered).cast("long").alias("chunk"), "heading", "text", "start", "stop")


def merged_keys(questions: DataFrame, options: DataFrame) -> DataFrame:
    """id, points, option of questions (id, points): the known option (id, option) makes a point of its own where a question has no points or the option is known.

    The union of a question's own scheme and a key: an option overrides, else the scheme stays, and without both there are no points.
    """
    joined = questions.join(options.select("id", "option"), "id", "left")
    return joined.select("id", F.when(F.col("option").isNotNull(), F.array(F.concat(F.lit("option "), "option"))).otherwise(F.coalesce("points", F.array().cast("array<string>"))).alias("points"), "option")


def recommended(misconception: Column, evidence: Column, accuracy: Column, mastery: Column) -> Column:
    """What a progress report recommends for a concept: a known misconception's own action, more evidence under three answers, a look at unsteady answers, else to teach it anew."""
    return F.when(misconception.isNotNull(), F.concat(F.lit("misconception:"), misconception)).when(evidence < 3, "more_evidence").when(accuracy < mastery, "unsteady").otherwise("reteach")


def reported(views: DataFrame, strong: float = 0.85, weak: float = 0.55) -> DataFrame:
    """learner_id and headline counts of a progress report over (learner_id, mastery, evidence): concepts, strong, weak, mean mastery, answers."""
    return views.groupBy("learner_id").agg(F.count("*").alias("concepts"), F.count_if(F.col("mastery") >= strong).alias("strong"), F.count_if(F.col("mastery") < weak).alias("weak"), F.avg("mastery").alias("mastery"), F.sum("evidence").alias("evidence"))


def critic(relevant: Column, support: Column, utility: Column) -> Column:
    """The weighed score of a reflection: relevance 1 or 0, support full, partial or none, utility 1 to 5; without a judgement relevance and support are neutral."""
    backed = F.when(F.lower(support) == "full", 1.0).when(F.lower(support) == "partial", 0.5).otherwise(0.0)
    useful = F.when(utility.between(1, 5), (utility - 3) / 2).otherwise(0.0)
    return F.when(relevant.isNull(), 1.0).otherwise(relevant.cast("double") + backed + 0.5 * useful)


def scheme_evidence(hits: DataFrame, word: str = "marking") -> DataFrame:
    """Of each query's hits (query_id, id, text) those that mention the word, or all where none does."""
    marked = hits.withColumn("mentions", F.contains(F.lower("text"), F.lit(word)))
    some = marked.groupBy("query_id").agg(F.bool_or("mentions").alias("some"))
    return marked.join(some, "query_id").where(F.col("mentions") | ~F.col("some")).select("query_id", "id")
