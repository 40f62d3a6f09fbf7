"""Queries over stored tables, extracted objects and typed graphs; they join the suite's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import curriculum, extraction, graph, learners, memory, retrieval, stores
from scholia.plans import suite
from scholia.plans.suite import query
from scholia.sources import shared, views

KINDS = ("PREREQUISITE_OF", "RELATED_TO", "SUPPORTED_BY")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes: id, type, label, status, academic_year."""
    kind = F.get(F.array(*(F.lit(x) for x in ("CONCEPT", "QUESTION_PAPER", "ANSWER_SCHEME", "ASSESSMENT_BLUEPRINT"))), (F.col("p_partkey") % 4).cast("int"))
    year = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("20"), 20 + F.col("p_size") % 5))
    return views.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 2 == 0, "draft").otherwise("active").alias("status"), year.alias("academic_year"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Parts and their suppliers as edges: id, source, target, type."""
    kind = F.get(F.array(*(F.lit(x) for x in KINDS)), ((F.col("l_partkey") + F.col("l_suppkey")) % 3).cast("int"))
    sides = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    return views.table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(F.concat_ws("-", *sides).alias("id"), sides[0].alias("source"), sides[1].alias("target"), kind.alias("type"))


def _concept_edges(spark: SparkSession, d: str) -> DataFrame:
    """Forward edges of concepts with a type, predicates and a span."""
    a, b = (F.substring(c, 2, 9).cast("int") for c in ("source", "target"))
    said = F.when((a * 3 + b) % 4 == 0, F.array(F.lit("Requires"))).when((a * 3 + b) % 4 == 1, F.array(F.lit("is"), F.lit("needs"))).when((a * 3 + b) % 4 == 2, F.array(F.lit("has")))
    return graph.ordered(views.edges(spark, d)).select("source", "target", F.get(F.array(*(F.lit(x) for x in KINDS)), (a + b) % 3).alias("type"), said.alias("predicates"), F.when(a * b % 5 == 0, "it depends on that").alias("span"))


def _label_edges(spark: SparkSession) -> DataFrame:
    """Links between the labels by a rule on their numbers, as a graph and as pages."""
    n = len(suite.LABELS)
    names = F.array(*(F.lit(x) for x in suite.LABELS))
    i, j = F.expr(f"CAST(id DIV {n} AS INT)"), F.expr(f"CAST(id % {n} AS INT)")
    every = spark.range(n * n).where((i != j) & ((7 * i + 3 * j) % 4 == 0))
    return every.select(F.get(names, i).alias("source"), F.get(names, j).alias("target"), F.lit("RELATED_TO").alias("type"), F.when((i + j) % 3 == 0, F.array(F.lit("requires"))).otherwise(F.array(F.lit("is"))).alias("predicates"), F.lit(None).cast("string").alias("span"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as page blocks; every third one begins a question, every third is a part."""
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL")
    n = F.col("turn").cast("int")
    text = F.when(n % 3 == 0, F.concat(n + 1, F.lit(". "), "text", F.lit(" ("), 1 + n % 4, F.lit(" marks)"))).when(n % 3 == 1, F.concat(F.lit("("), F.get(F.array(*(F.lit(c) for c in "abcde")), n % 5), F.lit(") "), "text")).otherwise(F.col("text"))
    return turns.select(F.col("conv_id").alias("document_id"), F.expr("CAST(1 + turn DIV 4 AS BIGINT)").alias("page"), F.col("turn").cast("long").alias("place"), text.alias("text"))


@query
def event_range(spark, d):
    return stores.event_range(views.sequenced(spark, d), 7, 5).select("learner_id", "seq", "event_id", "kind")


@query
def node_scan(spark, d):
    return stores.node_scan(_nodes(spark, d), kind="CONCEPT", contains="RE").select("id", "label")


@query
def ledger_scan(spark, d):
    ledger = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("registered_at"))
    return stores.ledger_status(ledger, "P")


@query
def ledger_register(spark, d):
    orders = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    lines = views.table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_partkey") % 3).alias("source_id")).distinct()
    return graph.register(orders, lines.withColumn("status", F.lit("new")), "source_id")


@query
def table_select(spark, d):
    return stores.selected(views.table(spark, d, "customer"), "-c_acctbal", c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_acctbal")


@query
def table_update(spark, d):
    suppliers = views.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return stores.deleted(stores.updated(suppliers, {"s_name": "moved"}, s_nationkey=3), s_nationkey=5)


@query
def newest_assessments(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return stores.newest(orders, "o_orderpriority", "1-URGENT", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query
def graded_sheets(spark, d):
    return stores.sheet_counts(views.answers(spark, d))


@query
def school_templates(spark, d):
    n = F.col("n_nationkey")
    schools = views.table(spark, d, "nation").select(n.alias("school"), F.when(n % 4 == 0, F.concat(F.lit("t"), n * 3)).alias("chosen"))
    templates = views.table(spark, d, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("template"), F.col("s_nationkey").alias("school"), (F.col("s_suppkey") % 5 == 0).alias("is_default"))
    return stores.templates_of(schools, templates, "builtin")


@query
def graph_snapshot(spark, d):
    return stores.snapshot(_nodes(spark, d), views.edges(spark, d), views.table(spark, d, "region"), "nightly")


@query
def index_replace(spark, d):
    chunks = views.chunks(spark, d).select("id", "document_id", "text")
    return stores.replaced(chunks, chunks.where("document_id % 10 = 0 AND page = 1").withColumn("text", F.concat(F.lit("new "), "text")))


@query
def audit_append(spark, d):
    part = views.table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").cast("string").alias("assessment"), F.col("o_custkey").cast("string").alias("student"), F.lit(None).cast("string").alias("actor"), F.col("o_orderpriority").alias("details"))
    none = part.withColumns({"id": F.lit(""), "action": F.lit("")}).limit(0)
    return stores.appended(none, "graded", part).select("id", "at", "action", "assessment")


@query
def answer_key_put(spark, d):
    return stores.last_put(views.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query
def answer_key_stats(spark, d):
    part = views.table(spark, d, "part").select(F.col("p_brand").alias("paper"), F.when(F.col("p_size") % 2 == 0, F.lit("A")).alias("option"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("answer"))
    return stores.key_stats(part)


@query
def corpus_stats(spark, d):
    return stores.corpus_stats(views.table(spark, d, "documents"), "source")


@query
def question_blocks(spark, d):
    return extraction.questions(_blocks(spark, d))


@query
def question_parts(spark, d):
    return extraction.parts(_blocks(spark, d))


@query
def page_layout(spark, d):
    text = F.when(F.col("place") % 7 == 5, F.concat(F.lit("Section: "), F.col("place"))).when(F.col("place") % 7 == 6, F.concat(F.lit("a) "), "text")).when(F.col("place") % 7 == 4, F.concat(F.col("place"), F.lit(". "), F.substring("text", 1, 60))).otherwise(F.col("text"))
    blocks = _blocks(spark, d).withColumn("text", text).withColumn("kind", F.lit("paragraph")).withColumn("fontsize", (8 + (F.col("document_id") + 3 * F.col("place")) % 7).cast("double"))
    return extraction.layout(blocks).select("document_id", "place", "kind")


@query
def marking_points(spark, d):
    return extraction.marking_points(_blocks(spark, d))


@query
def paper_blueprints(spark, d):
    pages = views.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Blueprint of Marks "), "text")).otherwise(F.col("text")).alias("text"))
    return extraction.blueprints(pages)


@query
def question_types(spark, d):
    return views.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", extraction.question_type(F.col("text")).alias("type"), extraction.question_bloom(F.col("text")).alias("bloom"))


@query
def concept_labels(spark, d):
    words = views.table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", "[ \\n]+")).alias("label")).distinct()
    return words.select("label", extraction.meaningful(F.col("label")).alias("meaningful"))


@query
def scorable_questions(spark, d):
    asked = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "mcq").otherwise("short_answer").alias("type"), F.when(F.col("p_size") % 5 == 0, "which (A) this (B) that").otherwise("say why").alias("stem"), F.when(F.col("p_size") % 7 == 0, "B").alias("option"))
    keys = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return extraction.scorable(asked, keys).select("id", "scorable")


@query
def heading_chunks(spark, d):
    lines = views.chunks(spark, d)
    place = F.split("id", ":")[1].cast("long")
    words = lines.select("document_id", F.posexplode(F.split("text", "(?<=[.]) ")).alias("n", "text"), "page", place.alias("line"))
    text = F.when(F.col("n") % 6 == 0, F.concat(F.lit("Chapter "), F.col("n") + 1)).otherwise(F.col("text"))
    return extraction.chunks(words.select("document_id", "page", (F.col("line") * 1_000_000 + F.col("n")).alias("place"), text.alias("text")), 400)


@query
def merged_answer_keys(spark, d):
    part = views.table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 > 0, F.array(F.col("p_brand"), F.col("p_type"))).alias("points"))
    options = part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("id"), F.lit("C").alias("option"))
    return extraction.merged_keys(asked, options).select("id", F.array_join("points", ";").alias("points"), "option")


@query
def progress_actions(spark, d):
    rated = learners.mastery(views.sequenced(spark, d), views.now_us())
    number = F.substring("concept_id", 2, 9).cast("int")
    return rated.select("learner_id", "concept_id", extraction.recommended(F.when(number % 9 == 0, "motion"), F.col("attempts"), F.col("accuracy"), F.col("mastery")).alias("action"))


@query
def progress_summary(spark, d):
    return extraction.reported(learners.mastery(views.sequenced(spark, d), views.now_us()).withColumn("evidence", F.col("attempts")))


@query
def critic_scores(spark, d):
    n = F.col("p_size")
    support = F.get(F.array(F.lit("full"), F.lit("Partial"), F.lit("none")), (n % 3).cast("int"))
    return views.table(spark, d, "part").select("p_partkey", extraction.critic(F.when(n % 7 > 0, n % 2 == 0), support, n % 6).alias("score"))


@query
def scheme_evidence(spark, d):
    turns = views.table(spark, d, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), "text")
    return extraction.scheme_evidence(turns, "the")


@query
def concept_chain(spark, d):
    suite._checkpoints(spark)
    return graph.chain(_typed(spark, d), spark.createDataFrame([("p1",)], "id string"))


@query
def evidence_chain(spark, d):
    suite._checkpoints(spark)
    return graph.evidence_chain(_typed(spark, d), spark.createDataFrame([("p2",)], "id string")).select("start", "id", "depth", "edge", "type")


@query
def exam_pattern(spark, d):
    return graph.exam_pattern(_nodes(spark, d), "a", "202").select("id", "type")


@query
def reasoning_paths(spark, d):
    suite._checkpoints(spark)
    return graph.reasoning_paths(_concept_edges(spark, d), "c0", "c19", 3)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the queries: parts whose names have one of their words; the queries are the names of four parts."""
    asked = views.table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return graph.anchored(_nodes(spark, d), asked, X.keywords(F.col("query")))


@query
def query_subgraph(spark, d):
    return graph.subgraph(_typed(spark, d), shared.written(_anchors(spark, d)), 2)


@query
def object_graph(spark, d):
    blocks = _blocks(spark, d)
    nodes, edges = graph.objects(extraction.questions(blocks), extraction.parts(blocks))
    return nodes.groupBy("type").agg(F.count("*").alias("n")).unionByName(edges.groupBy("type").agg(F.count("*").alias("n")))


@query
def hybrid_graph_search(spark, d):
    chunks, asked = views.chunks(spark, d), suite._questions(spark)
    linked = views.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    anchors = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (2, "e")], "query_id int, id string")
    return retrieval.hybrid(chunks, asked, 12, linked=linked, anchors=anchors)


@query
def prereq_votes_all(spark, d):
    """All six criteria: order, grades, links, headings, texts and pages."""
    found, edges = suite._found(spark, d), _label_edges(spark)
    grades = views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (6 + F.col("doc_id") % 5).alias("grade"))
    return curriculum.votes(found, curriculum.link_stats(edges, any_predicate=True), grades=grades, required=curriculum.text_prerequisites(edges), pages=edges)


@query
def link_stats(spark, d):
    return curriculum.link_stats(_concept_edges(spark, d))


@query
def text_prereqs(spark, d):
    return curriculum.text_prerequisites(_concept_edges(spark, d))


@query
def concept_profile(spark, d):
    """Occurrence, votes, closure, difficulty and hours of the labels, in one plan."""
    found = suite._found(spark, d)
    voted = curriculum.votes(found)
    closed = graph.closure(voted.select("concept", "prerequisite", "score")).groupBy(F.col("concept").alias("label")).agg(F.count("*").alias("closure"))
    profiles = curriculum.profiles(found, voted).select("label", "chunks", "documents", "prerequisites", "difficulty", "hours")
    return profiles.join(closed, "label", "left").fillna(0, ["closure"])


@query
def short_term_stability(spark, d):
    """The same-day formula beside the cards."""
    return memory.cards(views.sequenced(spark, d)).select("learner_id", "concept_id", memory.same_day(F.col("stability"), F.lit(3)).alias("stability"))
