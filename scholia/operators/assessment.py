"""Question banks, papers, grading, duplicates and rollups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.sources import shared

NEAR = 0.75
#: Places in tables of counts, whatever the number of words (a power of two), and longs of the bits of a set.
BUCKETS, SIGNED = 1 << 21, 16
#: Pairs that are checked together, about.
CELL = 4096
# Sections of a default paper: label, marks a question, share of the marks, difficulties.
LAYOUT = (("A", 1, 0.25, ("easy", "medium")), ("B", 2, 0.15, ("easy", "medium")), ("C", 3, 0.25, ("medium",)), ("D", 5, 0.25, ("medium", "hard")), ("E", 4, 0.10, ("medium", "hard")))


def sections(total: int) -> list[tuple[str, int, int, tuple[str, ...]]]:
    """label, marks a question, number of questions, difficulties; the last section takes what is left."""
    out, used = [], 0
    for i, (label, each, part, ease) in enumerate(LAYOUT):
        marks = max(0, total - used if i == len(LAYOUT) - 1 else round(total * part))
        n = max(1, round(marks / each)) if marks else 0
        if n:
            used += n * each
            out.append((label, each, n, ease))
    return out


def exact_duplicates(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The rows with the first row of the same normalised text, by order: column first."""
    key = F.sha1(X.normalized(F.col(text)))
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(order).alias("first"))
    return keyed.join(first, "__key").drop("__key")


def _word_sets(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    return rows.select(F.col(row_id).alias("id"), F.array_sort(X.words(F.coalesce(F.col(text), F.lit("")))).alias("words"))


def near_classes(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    """id, class of every row: the smallest id of the rows of equal content words; a row of under 4 words is its own class."""
    sets = _word_sets(rows, text, row_id)
    keyed = sets.where(F.size("words") >= 4).select("id", F.sha2(F.array_join("words", " "), 256).alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("class"))
    return keyed.join(least, "key").select("id", "class").unionByName(sets.where(F.size("words") < 4).select("id", F.col("id").alias("class")))


def _ranked(counts: np.ndarray, threshold: float):
    """Prefixes of sets (id, words): the first n - ceil(threshold * n) + 1 words by their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes = b.column("words").flatten().to_numpy(), pc.list_value_length(b.column("words")).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((words, counts[words & (BUCKETS - 1)], row))
            at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(at < np.repeat(sizes - np.ceil(threshold * sizes).astype(np.int64) + 1, sizes))
            w = words[order[keep]]
            more = counts[w & (BUCKETS - 1)] > 1  # a word that no other set has joins nothing
            keep, w = keep[more], w[more]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[keep])), pa.array(sizes[row[keep]].astype(np.int32)), pa.array(at[keep].astype(np.int32)), pa.array(w)], names=["id", "n", "i", "w"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as 64 * SIGNED bits, in which each word has one."""
    for b in batches:
        words, sizes = b.column("words").flatten().to_numpy(), pc.list_value_length(b.column("words")).to_numpy()
        bits = np.zeros((len(sizes), SIGNED), np.uint64)
        place = (words >> 21).astype(np.uint64) % np.uint64(64 * SIGNED)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in bits.T)], names=["id", *(f"s{k}" for k in range(SIGNED))])


def _among(met: np.ndarray):
    """Rows whose hash h is among those met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(met[b.column("h").to_numpy()])).select(["id", "words"])

    return run


def _verified(threshold: float):
    """Pairs (x, y) of sets (id, words) whose Jaccard similarity is at least the threshold."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        words, ids = [w.values.to_numpy() for c in sets.column("words").chunks for w in c], sets.column("id").combine_chunks()
        x, y = (pc.index_in(pairs.column(c), value_set=ids).to_numpy() for c in ("x", "y"))
        common = np.array([len(np.intersect1d(words[i], words[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], float)
        size = np.array([len(w) for w in words], float)
        similarity = common / (size[x] + size[y] - common)
        near = pa.table({"a": pairs.column("x"), "b": pairs.column("y"), "similarity": similarity})
        return near.filter(pa.array(similarity >= threshold))

    return run


def near_pairs(rows: DataFrame, text: str, row_id: str, threshold: float = NEAR) -> DataFrame:
    """a, b, similarity of rows (a < b) whose content words have at least the threshold in common.

    Rows of equal words are one class, so that copies cost nothing and large groups of them no pairs: a class is
    its smallest id, and near_classes has the class of every row. Words are compared by 64-bit hashes. Prefix filtering: in any one order of all words, two sets within
    the threshold share a word among the first n - ceil(threshold * n) + 1; the equi-join is on these words. The order is by counts of words in a table of BUCKETS
    (words that share a place count together), which every task has, so that sets are ranked where they stand. Positional filtering: what stands behind a
    shared word in both sets bounds their common words. Then sets as bits do: words of one set whose bits the other lacks are not common. Only the sets of pairs that are left are compared as a whole. Rows of under 4 words have no part.
    """
    sets = _word_sets(rows, text, row_id).where(F.size("words") >= 4)
    hashed = sets.select("id", F.array_sort(F.transform("words", lambda w: F.xxhash64(w))).alias("words"))
    # written once: the counts, the prefixes, the bits and the check read it
    classes = shared.written(hashed.groupBy(F.sha2(F.array_join("words", " "), 256).alias("digest")).agg(F.min("id").alias("id"), F.any_value("words").alias("words")).drop("digest"))
    kind = classes.schema["id"].dataType.simpleString()
    told = classes.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("k")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[told.column("k").to_numpy()] = np.minimum(told.column("n").to_numpy(), 2**31 - 1)
    prefix = classes.mapInArrow(_ranked(counts, threshold), f"id {kind}, n int, i int, w long")
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    # of a pair's shared words the first in the order of rarity bounds what is common, so a pair that is near passes there
    least = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    placed = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= least
    met = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & sized & placed)
    pairs = met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).distinct()
    bits = classes.mapInArrow(_signed, f"id {kind}, " + ", ".join(f"s{k} long" for k in range(SIGNED)))
    l, r = bits.alias("l"), bits.alias("r")
    lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.s{k}").bitwiseAND(F.bitwise_not(f"{q}.s{k}"))) for k in range(SIGNED)), F.lit(0))
    common = F.least(F.col("nx") - lacks("l", "r"), F.col("ny") - lacks("r", "l"))
    left = shared.written(pairs.join(l, F.col("x") == F.col("l.id")).join(r, F.col("y") == F.col("r.id")).where(common >= threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9).select("x", "y"))
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    still = np.zeros(BUCKETS, bool)
    still[left.select(F.explode(F.array(h("x"), h("y"))).alias("h")).distinct().toArrow().column("h").to_numpy()] = True
    whole = classes.select("id", "words", h("id").alias("h")).mapInArrow(_among(still), f"id {kind}, words array<long>")
    # near copies of one text share their least neighbour: their pairs meet in cells, to which a set goes once, however many pairs it has there
    near = left.join(left.groupBy("y").agg(F.min("x").alias("cell")), "y")
    parts = near.groupBy("cell").agg(F.ceil(F.sqrt(F.count("*") / CELL)).cast("int").alias("k"))
    dealt = shared.written(near.join(parts, "cell").select("cell", *(F.pmod(F.xxhash64(c), "k").cast("int").alias(n) for c, n in (("x", "p"), ("y", "q"))), "x", "y"))
    of = [F.col("cell").alias("c"), F.col("p").alias("m"), F.col("q").alias("n")]
    members = dealt.select(*of, F.col("x").alias("id")).union(dealt.select(*of, "y")).distinct().join(whole, "id")
    return dealt.groupBy("cell", "p", "q").cogroup(members.groupBy("c", "m", "n")).applyInArrow(_verified(threshold), f"a {kind}, b {kind}, similarity double")


def greedy(pairs: DataFrame) -> DataFrame:
    """id, accepted: what one pass in the order of ids keeps when each row is compared with the kept ones only.

    The same as the first maximal independent set by order: in each round, rows whose smaller neighbours are all rejected are
    kept and their neighbours rejected. Each round decides at least the smallest open row; the rounds go on until none is open.
    """
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("state", F.lit(0))
    while True:
        smaller = pairs.join(nodes.select(F.col("id").alias("a"), F.col("state").alias("s")), "a").groupBy("b").agg(F.max("s").alias("most"), F.min("s").alias("least"), F.count_if(F.col("s") == 0).alias("open"))
        joined = nodes.join(smaller, nodes.id == smaller.b, "left")
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("most") == 1, -1).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        nodes = joined.select("id", state.alias("state")).checkpoint()
        if nodes.where("state = 0").isEmpty():
            return nodes.select("id", (F.col("state") == 1).alias("accepted"))


def near_accepted(rows: DataFrame, text: str, row_id: str, threshold: float = NEAR) -> DataFrame:
    """id, class, accepted of every row: what one pass in the order of ids keeps of all rows.

    Of a class only its smallest id can be kept: the others equal it, or fall to the row that it fell to.
    """
    kept = greedy(near_pairs(rows, text, row_id, threshold).checkpoint()).select(F.col("id").alias("class"), F.col("accepted").alias("__kept"))
    return near_classes(rows, text, row_id).join(kept, "class", "left").select("id", "class", ((F.col("id") == F.col("class")) & F.coalesce("__kept", F.lit(True))).alias("accepted"))


def search(bank: DataFrame, *, chapters: list[str] | None = None, marks: int | None = None, difficulty: str | None = None, bloom: str | None = None, keyword: str | None = None, least_quality: float | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Questions that meet every filter given, by falling quality, then id."""
    kept = bank
    for condition in (
        F.col("chapter").isin(chapters) if chapters else None, F.col("marks") == marks if marks is not None else None, F.col("difficulty") == difficulty if difficulty else None, F.col("bloom") == bloom if bloom else None,
        F.contains(F.lower("stem"), F.lit(keyword.lower())) if keyword else None, F.col("quality") >= least_quality if least_quality is not None else None,
    ):
        kept = kept if condition is None else kept.where(condition)
    return kept.orderBy(F.desc("quality"), "id").offset(offset).limit(limit)


def select_paper(bank: DataFrame, blueprint: list[tuple[str, int, int, tuple[str, ...]]], weights: dict[str, float], fallback: DataFrame | None = None) -> DataFrame:
    """section, place and the question of each one taken, section after section: quality + 0.5 weight of its chapter - 0.05 uses of the chapter so far.

    One top-k a section (few), as uses change only between sections; a question is taken once. Where the bank falls short, the best-scoring questions of
    the fallback pool (other ids) that fit fill the section up before its questions are ranked.
    """
    spark = bank.sparkSession
    bank = bank.withColumn("__pool", F.lit(0))
    if fallback is not None:
        bank = bank.unionByName(fallback.withColumn("__pool", F.lit(1)))
    weighted = bank.withColumn("__w", F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("chapter")), F.lit(0.0))) if weights else bank.withColumn("__w", F.lit(0.0))
    taken = spark.createDataFrame([], "section string, place long, id long, chapter string, marks long, score double").withColumn("id", F.col("id").cast(bank.schema["id"].dataType))
    for label, each, n, ease in blueprint:
        uses = taken.groupBy("chapter").agg(F.count("*").alias("__uses"))
        fits = weighted.where((F.col("marks") == each) & F.col("difficulty").isin(*ease)).join(taken.select("id"), "id", "left_anti").join(F.broadcast(uses), "chapter", "left")  # uses: at most one row a taken question
        scored = fits.withColumn("score", F.col("quality") + 0.5 * F.col("__w") - 0.05 * F.coalesce("__uses", F.lit(0)))
        top = scored.orderBy("__pool", F.desc(F.round("score", 9)), "id").limit(n)
        placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).cast("long"))  # n rows
        taken = taken.unionByName(placed.select(F.lit(label).alias("section"), "place", "id", "chapter", "marks", "score")).checkpoint()
    return taken


def paper_metrics(selected: DataFrame, bank: DataFrame) -> DataFrame:
    """kind, value, questions, marks: histograms of a selected paper by chapter, Bloom level and difficulty."""
    known = selected.select("id", "marks").join(bank.select("id", "chapter", "bloom", "difficulty"), "id")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("chapter", "bloom", "difficulty"))))
    return known.select("marks", kinds.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("questions"), F.sum("marks").alias("marks"))


def assemble(selected: DataFrame) -> DataFrame:
    """The selected questions, numbered through in the order of sections."""
    return selected.withColumn("number", F.row_number().over(Window.orderBy("section", "place")).cast("long"))  # as many rows as a paper has questions


def practice(weak: DataFrame, bank: DataFrame, n: int = 3) -> DataFrame:
    """For each weak concept of a learner the n first questions of that chapter, by difficulty and falling quality: learner_id, chapter, id, rank."""
    ease = F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2).otherwise(3)
    order = Window.partitionBy("chapter").orderBy(ease, F.desc("quality"), "id")
    first = bank.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("chapter", "id", "rank")
    return weak.join(first, "chapter").select("learner_id", "chapter", "id", "rank")


def chapter_tags(rows: DataFrame, text: str, row_id: str, chapters: dict[str, tuple[str, ...]]) -> DataFrame:
    """The chapter of most keyword hits in each text (first of equal ones), its hits and confidence; null without a hit."""
    low = F.lower(F.col(text))
    scores = [F.struct(sum((F.contains(low, F.lit(k)).cast("long") for k in words), F.lit(0).cast("long")).alias("hits"), F.lit(-i).alias("i"), F.lit(name).alias("chapter")) for i, (name, words) in enumerate(chapters.items())]
    best = F.array_max(F.array(*scores))
    out = rows.select(F.col(row_id), best.alias("b"))
    hit = F.col("b.hits") > 0
    return out.select(row_id, F.when(hit, F.col("b.chapter")).alias("chapter"), F.col("b.hits").alias("hits"), F.least(F.lit(1.0), F.col("b.hits") / 3).alias("confidence"))


def misconceptions(rows: DataFrame, answer: str, row_id: str, catalog: dict[str, tuple[str, ...]], severity: float = 0.6) -> DataFrame:
    """Score of each misconception that an answer's words point to: row id, misconception, score over 0."""
    toks = F.array_distinct(F.filter(X.tokens(F.col(answer)), lambda t: F.length(t) > 1))
    entries = F.array(*[F.struct(F.lit(name).alias("misconception"), F.array(*[F.lit(w) for w in sorted(words)]).alias("words")) for name, words in catalog.items()])
    listed = rows.select(F.col(row_id), toks.alias("tokens"), F.explode(entries).alias("m"))
    score = F.least(F.lit(1.0), F.size(F.array_intersect("tokens", "m.words")) / F.size("m.words")) * severity
    return listed.select(row_id, "m.misconception", score.alias("score")).where(F.col("score") > 0)


def graded(rows: DataFrame, answer: str, points: Column, most: Column) -> DataFrame:
    """Marks of descriptive answers: rows with awarded, verdict, confidence and needs_review. points: array of (keyword, marks).

    A blank answer has none; one of under 8 characters or a scheme without points goes to review. A keyword with a space is found as a part, a single word as a word.
    """
    low = F.lower(F.col(answer))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z][a-z0-9-]+)"), F.lit(1)))
    found = lambda p: F.when(F.contains(p["keyword"], F.lit(" ")), F.contains(low, F.lower(p["keyword"]))).otherwise(F.array_contains(words, F.lower(p["keyword"])))
    blank = (~F.coalesce(F.col(answer), F.lit("")).rlike("[A-Za-z0-9]")) | F.lower(F.trim(F.regexp_replace(F.col(answer), "[.! ]+$", ""))).isin(*X.BLANK)
    short = F.length(F.trim(F.col(answer))) < 8
    hits = F.filter(points, found)
    total = F.aggregate(hits, F.lit(0).cast("long"), lambda n, p: n + p["marks"])
    part = F.size(hits) / F.greatest(F.size(points), F.lit(1))
    sure = 0.9 - 0.5 * (1 - F.abs(2 * part - 1)) - F.when(F.length(F.col(answer)) < 25, 0.1).otherwise(0.0)
    flags = F.size(X.ocr_flags(F.col(answer))) > 0
    out = rows.withColumn("__g", F.least(total, most)).withColumn("__c", F.greatest(F.lit(0.05), F.least(F.lit(0.95), sure - F.when(flags, 0.25).otherwise(0.0))))
    unsure = short | (F.size(points) == 0)
    return out.select(
        *rows.columns, F.when(blank | unsure, 0).otherwise(F.col("__g")).cast("long").alias("awarded"),
        F.when(blank, "blank").when(unsure, "noCredit").when(F.col("__g") >= most, "fullCredit").when(F.col("__g") > 0, "partialCredit").otherwise("noCredit").alias("verdict"),
        F.when(blank, 1.0).when(unsure, 0.3).otherwise(F.col("__c")).alias("confidence"), F.when(blank, False).when(unsure, True).otherwise((F.col("__c") < 0.75) | flags).alias("needs_review"),
    )


def objective(rows: DataFrame, answer: str, key: Column) -> DataFrame:
    """Choice, verdict and confidence of answers to objective questions: the first option letter counts, more than one goes to review."""
    letters = F.array_distinct(F.regexp_extract_all(F.upper(F.col(answer)), F.lit(r"\b(?:OPTION\s*)?\(?([A-D])\)?\b"), F.lit(1)))
    chosen = F.get(letters, 0)
    sure = F.when(F.size(letters) > 1, 0.5).otherwise(0.93)
    return rows.select(*rows.columns, chosen.alias("chosen"), F.when(chosen == key, "fullCredit").otherwise("noCredit").alias("verdict"), F.when(chosen.isNull(), 0.45).otherwise(sure).alias("confidence"), (chosen.isNull() | (F.size(letters) > 1)).alias("needs_review"))


def timetable(units: DataFrame, periods: int, weeks: int) -> DataFrame:
    """Periods of each unit (unit_no, marks) by largest remainders, and the first and last week they fill. A syllabus has few units."""
    total = periods * weeks
    share = total * F.col("marks") / F.sum("marks").over(Window.partitionBy())
    floors = units.withColumn("raw", share).withColumn("base", F.floor("raw"))
    order = Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), "unit_no")
    left = total - F.sum("base").over(Window.partitionBy())
    fixed = floors.withColumn("periods", F.col("base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0))
    end = F.sum("periods").over(Window.orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0))
    return fixed.select("unit_no", "marks", F.col("periods").cast("long").alias("periods"), (F.floor((end - F.col("periods")) / periods) + 1).cast("long").alias("first_week"), (F.floor((end - 1) / periods) + 1).cast("long").alias("last_week"))


def class_report(answers: DataFrame, *, weak: float = 0.6) -> DataFrame:
    """For each assessment and concept: mean of its students' ratios, students, those at risk, priority and minutes."""
    per = answers.groupBy("assessment", "concept", "student").agg((F.sum("awarded") / F.sum("max_marks")).alias("ratio"))
    roster = answers.groupBy("assessment").agg(F.count_distinct("student").alias("roster"))
    by = per.groupBy("assessment", "concept").agg(F.avg("ratio").alias("accuracy"), F.count("*").alias("students"), F.count_if(F.col("ratio") < weak).alias("at_risk"))
    joined = by.join(roster, "assessment")
    a = F.round(F.col("accuracy"), 9)
    minutes = F.when(a < 0.3, 45).when(a < 0.45, 30).when(a < 0.6, 20).otherwise(15).cast("long")
    return joined.select("assessment", "concept", a.alias("accuracy"), "students", "at_risk", F.round((1 - a) * F.col("at_risk") / F.col("roster"), 9).alias("priority"), minutes.alias("minutes"))


def shared_gaps(answers: DataFrame, n: int = 10) -> DataFrame:
    """Gaps of more than one student of an assessment: students, their share of all, the n most common."""
    roster = answers.groupBy("assessment").agg(F.count_distinct("student").alias("roster"))
    by = answers.where("awarded < max_marks / 2").groupBy("assessment", "gap").agg(F.count_distinct("student").alias("students")).where("students > 1").join(roster, "assessment")
    order = Window.partitionBy("assessment").orderBy(F.desc("students"), "gap")
    return by.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("assessment", "gap", "students", (100.0 * F.col("students") / F.col("roster")).alias("percent"), "rank")


def school_report(answers: DataFrame, schools: DataFrame) -> DataFrame:
    """For each school (student, school): students, mean of their means, concepts met, the weakest concept."""
    per = answers.join(schools, "student").groupBy("school", "student", "concept").agg((F.sum("awarded") / F.sum("max_marks")).alias("ratio"))
    students = per.groupBy("school", "student").agg(F.avg("ratio").alias("mean")).groupBy("school").agg(F.count("*").alias("students"), F.avg("mean").alias("mean"))
    concepts = per.groupBy("school", "concept").agg(F.avg("ratio").alias("r")).groupBy("school").agg(F.count("*").alias("concepts"), F.min_by("concept", F.struct(F.round("r", 9), "concept")).alias("weakest"))
    return students.join(concepts, "school")


def sheet_totals(answers: DataFrame) -> DataFrame:
    """awarded, max_marks and percent of each student's sheet, and how many answers need review (under a tenth of the marks)."""
    sums = answers.groupBy("assessment", "student").agg(F.sum("awarded").alias("awarded"), F.sum("max_marks").alias("max_marks"), F.count_if(F.col("awarded") < 0.1 * F.col("max_marks")).alias("review"))
    return sums.withColumn("percent", 100 * F.col("awarded") / F.col("max_marks"))


def catalog(bank: DataFrame) -> DataFrame:
    """Questions, distinct marks (joined, in order) and mean quality of each chapter and difficulty, with totals (null)."""
    return bank.cube("chapter", "difficulty").agg(F.count("*").alias("questions"), F.array_join(F.array_sort(F.collect_set(F.col("marks"))), ",").alias("marks"), F.avg("quality").alias("quality"))


def at_risk(answers: DataFrame, weak: float = 0.5) -> DataFrame:
    """Students whose mean ratio is under the threshold: ratio, answers, distinct concepts."""
    return answers.groupBy("student").agg((F.sum("awarded") / F.sum("max_marks")).alias("ratio"), F.count("*").alias("answers"), F.count_distinct("concept").alias("concepts")).where(F.col("ratio") < weak)


def segments(turns: DataFrame, doc: str, order: str, text: str, marker: str = r"^ *(?:[Qq][. ]*)?([0-9]{1,2}) *[.)] *") -> DataFrame:
    """Answers of each document: lines after a question marker belong to it up to the next; lines before any are left out. doc, question, text, lines."""
    lines = turns.select(doc, order, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    number = F.regexp_extract("raw", marker, 1)
    marked = lines.withColumn("q", F.when(number != "", number.cast("long"))).withColumn("body", F.regexp_replace("raw", marker, ""))
    carried = marked.withColumn("question", F.last("q", ignorenulls=True).over(Window.partitionBy(doc).orderBy(order, "line")))
    kept = carried.where("question IS NOT NULL")
    return kept.groupBy(doc, "question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line", "body"))), lambda x: x["body"]), "\n").alias("text"), F.count("*").alias("lines"))


def vote(passes: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """The text of a page that two passes agree on (normalised, first seen), else the longest; agreed tells which."""
    by = passes.withColumn("norm", X.normalized(F.col(text))).groupBy(page, "norm").agg(F.count("*").alias("n"), F.min(order).alias("seen"), F.min_by(text, order).alias("text"))
    best = by.groupBy(page).agg(F.min_by("text", F.struct(F.when(F.col("n") >= 2, F.struct(F.lit(0).alias("k"), F.col("seen").alias("s"))).otherwise(F.struct(F.lit(1).alias("k"), F.lit(None).cast(passes.schema[order].dataType).alias("s"))).alias("o"), (-F.length("text")).alias("l"), "seen")).alias("text"), (F.max("n") >= 2).alias("agreed"))
    return best
