"""The query suite over the driver tables: each entry takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import assessment, curriculum, fitting, graph, learners, memory, retrieval, stores, workflow
from scholia.sources import shared, views

Query = Callable[[SparkSession, str], DataFrame]
SEARCHES = ((1, "the idiot of things"), (2, "theory and nation src3"), (3, "la tion des"), (4, "version license public"))
PHRASES = ("of the", "license version", "general public license")
LABELS = ("the", "of", "and", "idiot", "clown", "license", "version", "est", "der", "tion")
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _checkpoints(spark: SparkSession) -> None:
    """Iterative operators cut their lineage in the shared folder; a local session without one gets its own, a cluster must set it."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            import tempfile

            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="scholia-")
        spark.sparkContext.setCheckpointDir(top)


def _mastered(spark: SparkSession, d: str) -> DataFrame:
    return learners.mastery(views.sequenced(spark, d), views.now_us())


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id int, query string")


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Written once: each criterion of a vote counts the occurrences anew."""
    return shared.written(curriculum.occurrences(views.chunks(spark, d), spark.createDataFrame([(x,) for x in LABELS], "label string")))


def _forward(spark: SparkSession, d: str) -> DataFrame:
    return graph.ordered(views.edges(spark, d))


def _prerequisites(spark: SparkSession, d: str) -> DataFrame:
    edges = _forward(spark, d)
    most = edges.agg(F.max("occurrences").alias("most"))
    return edges.crossJoin(F.broadcast(most)).select(F.col("target").alias("concept"), F.col("source").alias("prerequisite"), (F.col("occurrences") / F.col("most")).alias("score"))


@query
def learner_stats(spark, d):
    return learners.stats(views.events(spark, d))


@query
def learner_replay(spark, d):
    return learners.replay(views.sequenced(spark, d))


@query
def mastery(spark, d):
    return _mastered(spark, d)


@query
def mastery_status(spark, d):
    return learners.status(_mastered(spark, d)).select("learner_id", "concept_id", "mastery", "status")


@query
def weak_concepts(spark, d):
    return learners.weakest(_mastered(spark, d), 5).select("learner_id", "concept_id", "mastery", "rank")


@query
def overall_mastery(spark, d):
    return _mastered(spark, d).groupBy("learner_id").agg(F.avg("mastery").alias("mastery"), F.count("*").alias("concepts"))


@query
def emotion_summary(spark, d):
    return learners.emotions(views.events(spark, d))


@query
def motivation(spark, d):
    return learners.motivation(views.events(spark, d), views.now_us())


@query
def career_riasec(spark, d):
    events = views.events(spark, d)
    number = F.substring("concept_id", 2, 9).cast("int")
    subjects = events.select("concept_id").distinct().withColumn("subject", F.when(number % 3 == 0, "math").when(number % 3 == 1, "language"))
    return learners.riasec(events, subjects)


@query
def lifelong_years(spark, d):
    return learners.years(views.events(spark, d))


@query
def concept_continuity(spark, d):
    return learners.continuity(views.events(spark, d))


@query
def habit_streaks(spark, d):
    return learners.habits(views.events(spark, d), views.now_us())


@query
def attention_curve(spark, d):
    return learners.attention(views.events(spark, d))


@query
def session_windows(spark, d):
    stamped = views.events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    windows = stamped.groupBy("learner_id", F.session_window("at", "2 hours").alias("w")).agg(F.count("*").alias("events"))
    return windows.select("learner_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


@query
def forgetting_exponential(spark, d):
    return memory.exponential(views.sequenced(spark, d), views.now_us())


@query
def fsrs_cards(spark, d):
    return memory.cards(views.sequenced(spark, d))


@query
def fsrs_forecast(spark, d):
    return memory.forecast(memory.cards(views.sequenced(spark, d)), views.now_us())


@query
def revision_plan(spark, d):
    return memory.revision(fsrs_forecast(spark, d), _mastered(spark, d))


@query
def self_efficacy(spark, d):
    return learners.self_efficacy(views.sequenced(spark, d), views.now_us())


@query
def daily_blocks(spark, d):
    return memory.day_plan(fsrs_forecast(spark, d), self_efficacy(spark, d), _mastered(spark, d))


@query
def fsrs_fit(spark, d):
    return fitting.fit(views.sequenced(spark, d))


@query
def momentum(spark, d):
    return learners.momentum(views.sequenced(spark, d))


@query
def curiosity_rank(spark, d):
    number = F.col("id").cast("int")
    candidates = spark.range(25).select(F.concat(F.lit("c"), F.col("id")).alias("concept_id"), (0.4 + (number % 6) / 10).alias("difficulty"), F.concat(F.lit("d"), number % 3).alias("domain"))
    return learners.curiosity(_mastered(spark, d), momentum(spark, d), candidates, 5)


@query
def reward_policy(spark, d):
    last = views.sequenced(spark, d).groupBy("learner_id", "concept_id").agg(F.max_by("affect", "seq").alias("affect"), F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.col("seq"))).alias("outcome"))
    joined = _mastered(spark, d).join(last, ["learner_id", "concept_id"])
    snaps = joined.select(
        "learner_id", "concept_id", "attempts", F.round(F.col("accuracy") * F.col("attempts")).alias("streak"), "mastery", F.col("accuracy").alias("achievement"), F.coalesce(F.col("affect") == "frustrated", F.lit(False)).alias("frustrated"),
        F.coalesce((F.col("outcome") >= 0.4) & (F.col("outcome") < 0.5), F.lit(False)).alias("near_miss"), F.lit(False).alias("autonomy"), F.lit(False).alias("breakthrough"), F.lit(0.0).alias("relatedness"), F.lit(None).cast("double").alias("days_since_reward"),
    )
    return learners.rewards(snaps).select("learner_id", "concept_id", "action")


@query
def parent_guidance(spark, d):
    return learners.guidance(views.sequenced(spark, d))


@query
def graph_degree(spark, d):
    return graph.degrees(views.edges(spark, d))


@query
def concept_spine(spark, d):
    return graph.spine(views.edges(spark, d), 10)


@query
def bfs_neighbors(spark, d):
    _checkpoints(spark)
    return graph.neighbours(_forward(spark, d), spark.createDataFrame([("c0",)], "id string"), 3).where("id <> 'c0'")


@query
def graph_paths(spark, d):
    _checkpoints(spark)
    return graph.paths(_forward(spark, d).checkpoint(), "c0", "c19", 4)


@query
def prereq_closure(spark, d):
    return graph.closure(_prerequisites(spark, d))


@query
def topo_levels(spark, d):
    _checkpoints(spark)
    return graph.levels(_forward(spark, d))


@query
def prereq_plan(spark, d):
    _checkpoints(spark)
    learnt = _mastered(spark, d).groupBy("concept_id").agg(F.avg("mastery").alias("m")).where("m >= 0.5").checkpoint()
    return graph.prerequisite_plan(_forward(spark, d), "c19", learnt)


@query
def bm25_search(spark, d):
    return retrieval.bm25(views.chunks(spark, d), _questions(spark), 20)


@query
def tfidf_search(spark, d):
    return retrieval.tfidf(views.chunks(spark, d), _questions(spark), 20)


@query
def rrf_search(spark, d):
    chunks, asked = views.chunks(spark, d), _questions(spark)
    return retrieval.rrf(retrieval.bm25(chunks, asked, 24), retrieval.tfidf(chunks, asked, 24))


@query
def hybrid_search(spark, d):
    return retrieval.hybrid(views.chunks(spark, d), _questions(spark), 12)


@query
def heading_rerank(spark, d):
    chunks, asked = views.chunks(spark, d), _questions(spark)
    return retrieval.heading_prior(retrieval.bm25(chunks, asked, 20), chunks, asked)


@query
def phrase_scan(spark, d):
    return retrieval.phrase_hits(views.chunks(spark, d), spark.createDataFrame([(x,) for x in PHRASES], "phrase string"))


@query
def ir_metrics(spark, d):
    hits = bm25_search(spark, d).withColumn("doc", F.split("id", ":")[0].cast("long")).groupBy("query_id", "doc").agg(F.min("rank").alias("r0"))
    ranking = hits.select("query_id", F.col("doc").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("r0")).cast("long").alias("rank"))
    good = views.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("gain"))
    return retrieval.metrics(ranking, good.crossJoin(F.broadcast(_questions(spark).select("query_id"))), 10)  # four queries


def _neighbouring(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item with the next one's text."""
    items = views.table(spark, d, "benchmark").select("item_id", "text")
    return stores.with_next(items, "item_id", "text", "other").where("other IS NOT NULL").select("item_id", "text", "other")


@query
def token_f1(spark, d):
    return _neighbouring(spark, d).select("item_id", X.token_f1(F.col("text"), F.col("other")).alias("f1"))


@query
def bleu1(spark, d):
    return _neighbouring(spark, d).select("item_id", X.bleu1(F.col("text"), F.col("other")).alias("bleu"))


@query
def rouge_l(spark, d):
    return _neighbouring(spark, d).select("item_id", X.lcs_f1(F.col("text"), F.col("other")).alias("rouge"))


@query
def exact_match(spark, d):
    return _neighbouring(spark, d).select("item_id", X.exact_match(F.col("text"), F.col("other")).alias("same"))


@query
def groundedness(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL")
    answers = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer"), F.max("text").alias("evidence"))
    return answers.select("conv_id", X.groundedness(F.col("answer"), F.col("evidence")).alias("grounded"))


@query
def exact_dedup(spark, d):
    return assessment.exact_duplicates(views.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first")


@query
def near_dup_pairs(spark, d):
    return assessment.near_pairs(views.table(spark, d, "documents"), "text", "doc_id")


@query
def near_dup_greedy(spark, d):
    _checkpoints(spark)
    return assessment.near_accepted(views.table(spark, d, "documents"), "text", "doc_id")


@query
def near_dup_classes(spark, d):
    return assessment.near_classes(views.table(spark, d, "documents"), "text", "doc_id")


@query
def text_quality_flags(spark, d):
    docs = views.table(spark, d, "documents").where("text IS NOT NULL")
    text = F.col("text")
    return docs.select("doc_id", X.truncated(text).alias("truncated"), F.array_contains(X.ocr_flags(text), "fused_number").alias("fused"), F.array_contains(X.ocr_flags(text), "unresolved").alias("unresolved"))


@query
def encoding_flags(spark, d):
    text = F.coalesce("text", F.lit(""))
    return views.table(spark, d, "documents").select("doc_id", X.mangled(text).alias("mangled"), X.needs_figure(text).alias("needs_figure"), X.broken_options(text).alias("broken_options"), X.broken_fractions(text).alias("broken_fractions"), X.non_latin(text).alias("non_latin"))


@query
def clean_text(spark, d):
    return views.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.cleaned(F.col("text")).alias("text"))


CHAPTERS = {"licences": ("license", "public", "version"), "insults": ("idiot", "clown", "moron"), "english": ("the", "and", "of the")}


@query
def chapter_tags(spark, d):
    return assessment.chapter_tags(views.table(spark, d, "documents").where("text IS NOT NULL"), "text", "doc_id", CHAPTERS)


@query
def misconception_scores(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    return assessment.misconceptions(turns, "text", "turn_id", {"articles": ("the", "an"), "motion": ("force", "motion", "that", "with")})


@query
def evaluate_answers(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    points = F.array(F.struct(F.lit("the").alias("keyword"), F.lit(2).cast("long").alias("marks")), F.struct(F.lit("of the").alias("keyword"), F.lit(1).cast("long").alias("marks")))
    return assessment.graded(turns, "text", points, F.lit(3)).drop("text")


@query
def evaluate_objective(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.concat(F.lit("("), F.substring(F.lit("ABCD"), 1 + F.col("turn").cast("int") % 4, 1), F.lit(") "), "text").alias("answer"))
    return assessment.objective(turns, "answer", F.lit("B")).drop("answer")


@query
def answer_segments(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(1 + F.col("turn") % 7, F.lit(") "), "text")).otherwise(F.col("text")).alias("text"))
    return assessment.segments(turns, "conv_id", "turn", "text")


@query
def ocr_vote(spark, d):
    return assessment.vote(views.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query
def cooccurrence_pairs(spark, d):
    return curriculum.cooccurrence(_found(spark, d))


@query
def entropy(spark, d):
    return curriculum.entropy(_found(spark, d))


@query
def prereq_votes(spark, d):
    return curriculum.votes(_found(spark, d))


@query
def lo_layer(spark, d):
    found = _found(spark, d)
    return curriculum.profiles(found, curriculum.votes(found))


@query
def prereq_edges(spark, d):
    found = _found(spark, d)
    voted = curriculum.votes(found)
    return curriculum.edges(voted, curriculum.profiles(found, voted).select("label", "difficulty"), 3)


@query
def grade_pairs(spark, d):
    grades = views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (6 + F.col("doc_id") % 5).alias("grade"))
    return curriculum.grade_pairs(_found(spark, d), grades)


@query
def text_triples(spark, d):
    return curriculum.triples(views.table(spark, d, "documents").where("text IS NOT NULL"), "text")


@query
def chunk_packs(spark, d):
    return curriculum.heading_windows(views.chunks(spark, d))


@query
def class_insights(spark, d):
    return assessment.class_report(views.answers(spark, d))


@query
def at_risk(spark, d):
    return assessment.at_risk(views.answers(spark, d))


@query
def shared_gaps(spark, d):
    return assessment.shared_gaps(views.answers(spark, d))


@query
def school_rollup(spark, d):
    customers, nations = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    schools = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(F.col("c_custkey").alias("student"), F.col("n_name").alias("school"))
    return assessment.school_report(views.answers(spark, d), schools)


@query
def sheet_totals(spark, d):
    return assessment.sheet_totals(views.answers(spark, d))


@query
def catalog(spark, d):
    return assessment.catalog(views.questions(spark, d))


@query
def question_search(spark, d):
    return assessment.search(views.questions(spark, d), marks=3, difficulty="medium", least_quality=0.5).select("id", "chapter", "marks", "quality")


@query
def select_paper(spark, d):
    _checkpoints(spark)
    return assessment.select_paper(views.questions(spark, d), assessment.sections(80), {"Brand#13": 1.0, "Brand#42": 0.5})


@query
def assemble_paper(spark, d):
    return assessment.assemble(select_paper(spark, d))


@query
def practice_set(spark, d):
    weak = views.answers(spark, d).groupBy("student", "concept").agg((F.sum("awarded") / F.sum("max_marks")).alias("r")).where("r < 0.1").select(F.col("student").alias("learner_id"), F.col("concept").alias("chapter"))
    return assessment.practice(weak, views.questions(spark, d))


@query
def timetable(spark, d):
    units = views.table(spark, d, "region").select(F.col("r_regionkey").alias("unit_no"), (10 + 7 * F.col("r_regionkey")).alias("marks"))
    return assessment.timetable(units, 6, 16)


@query
def upsert_latest(spark, d):
    orders = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    cut = F.lit("1995-06-01").cast("date")
    return graph.upsert_latest(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "o_custkey", "at").select("o_custkey", "o_orderkey", "o_orderstatus", "version")


@query
def next_seq(spark, d):
    log = views.sequenced(spark, d)
    cut = F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    return graph.append_sequence(log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut).drop("seq"), "learner_id", ["t_us", "event_id"]).select("learner_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query
def ledger_dedupe(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    first = pages.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    return pages.join(first, "digest").select("page_id", "first_id", (F.col("page_id") != F.col("first_id")).alias("duplicate"))


@query
def bank_mapping(spark, d):
    part = views.table(spark, d, "part")
    raw = part.select(F.col("p_partkey").alias("id"), (1 + F.col("p_partkey") % 39).cast("string").alias("q_no"), F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("double")).alias("marks"), F.when(F.col("p_size") % 3 == 0, "analyze").alias("bloom"), F.col("p_brand").alias("chapter"), (F.col("p_size") / 50).alias("confidence"), F.lit("X").alias("grade"))
    return workflow.bank_rows(raw).drop("grade")


@query
def question_concepts(spark, d):
    concepts = spark.createDataFrame([("onesen erblest hein",), ("eroundth thwhesou the rest",), ("eaea ndorea",)], "concept string")
    asked = views.table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return workflow.concept_matches(asked, concepts, 0.01)


@query
def practice_outcome(spark, d):
    events = views.sequenced(spark, d)
    before = learners.mastery(events.where(F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")), views.now_us())
    return workflow.practice_result(before, learners.mastery(events, views.now_us()))


@query
def study_plan(spark, d):
    _checkpoints(spark)
    return workflow.study_plan(graph.levels(_forward(spark, d)), forgetting_exponential(spark, d).select("learner_id", "concept_id", "retention"))


@query
def extraction_accuracy(spark, d):
    parts = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("marks"), F.col("p_brand").alias("q_no"))
    return workflow.extraction_accuracy(parts, parts.withColumn("marks", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("marks"))), ("marks", "q_no"))


@query
def question_terms(spark, d):
    return views.table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.array_join(workflow.terms(F.col("text"), 5), ",").alias("terms"))


from scholia.plans import asked, kept, stored, told, worked  # noqa: E402,F401  they add their queries
