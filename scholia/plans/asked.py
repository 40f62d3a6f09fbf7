"""Queries that answer doubts and papers from hits, and that mine prerequisites from what pages and texts say; they join the suite's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import answering, curriculum, marking, retrieval, workflow
from scholia.plans import suite
from scholia.plans.suite import query
from scholia.sources import shared, views

#: Papers to analyse: the source that stands as their heading, with a topic.
PAPERS = ((1, "src3 license"), (2, "src4 version"), (3, "src1 idiot"))
#: Words that are frequent in one language; the language with most of a text's words is the one it is taken for.
COMMON = {"en": ("the", "of", "and", "is"), "de": ("der", "die", "und", "das"), "fr": ("le", "la", "et", "les"), "es": ("el", "los", "que", "y")}


@query
def doubt_answers(spark, d) -> DataFrame:
    chunks, asked = views.chunks(spark, d), suite._questions(spark)
    return answering.solved(shared.written(retrieval.hybrid(chunks, asked, answering.HITS)), asked, chunks)


@query
def critic_paths(spark, d) -> DataFrame:
    """The passage that a critic by words chooses among each doubt's hits; a doubt without keywords needs none."""
    chunks = views.chunks(spark, d)
    asked = suite._questions(spark).unionByName(spark.createDataFrame([(5, "what is the"), (6, "zzyzx")], "query_id int, query string"))
    hits = shared.written(retrieval.hybrid(chunks, asked, 6))
    needed = asked.select("query_id", (F.size(X.keywords(F.col("query"))) > 0).alias("retrieve"))
    return answering.reflected(hits, asked, chunks, answering.lexical_verdicts(hits, asked, chunks), needed)


@query
def scheme_citations(spark, d) -> DataFrame:
    """Hits for the marking scheme of each question, those under headings with src1 before all."""
    chunks = views.chunks(spark, d)
    asked = suite._questions(spark).withColumn("query", F.concat(F.lit("marking scheme "), "query"))
    return answering.schemes(shared.written(retrieval.hybrid(chunks, asked, answering.HITS)), chunks, word="src1")


@query
def paper_sections(spark, d) -> DataFrame:
    chunks = views.chunks(spark, d)
    asked = spark.createDataFrame([(i, f"question paper {x} marks") for i, x in PAPERS], "query_id int, query string")
    return answering.sections(shared.written(retrieval.hybrid(chunks, asked, 10)), chunks)


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in suite.LABELS], "label string")


def _grades(spark: SparkSession, d: str) -> DataFrame:
    """Longer texts are for later grades: the bits of a text's length."""
    return views.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.length(F.bin(F.length("text"))).alias("grade"))


@query
def grade_prereqs(spark, d) -> DataFrame:
    return curriculum.grade_prerequisites(suite._found(spark, d), _grades(spark, d))


@query
def page_links(spark, d) -> DataFrame:
    return curriculum.page_links(views.table(spark, d, "pages"), "html", _labels(spark))


@query
def prereq_votes_mined(spark, d) -> DataFrame:
    """All six criteria from what the tables say: order, headings, grades by length, links between pages, relations that texts state."""
    told = curriculum.told_edges(curriculum.triples(views.table(spark, d, "documents").where("text IS NOT NULL"), "text"), _labels(spark))
    said = shared.written(told)
    return curriculum.votes(
        suite._found(spark, d), curriculum.link_stats(said, any_predicate=True), grades=_grades(spark, d), required=curriculum.text_prerequisites(said), pages=shared.written(page_links(spark, d)),
    )


def _held(listed: tuple[str, ...]) -> Column:
    return F.size(F.filter("ts", lambda t: t.isin(*listed)))


@query
def language_accuracy(spark, d) -> DataFrame:
    """Accuracy of languages that are extracted by frequent words, against the languages of documents."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", X.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    counted = F.array(*(F.struct(_held(listed).alias("n"), F.lit(lang).alias("lang")) for lang, listed in COMMON.items()))
    best = F.array_max(counted)
    predicted = docs.select("id", F.when(best["n"] > 0, best["lang"]).alias("lang"))
    return workflow.extraction_accuracy(docs.select("id", "lang"), predicted, ("lang",))


@query
def paper_requests(spark, d) -> DataFrame:
    """Orders as requests for papers of customers' assessments, their larger lines as the selected questions: papers made and refused."""
    customers = views.table(spark, d, "customer").where("c_custkey % 5 <> 0")
    steps = F.array(*(F.lit(x) for x in ("draft", "approved", "review", None)))
    stored = customers.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("subject"), F.col("c_nationkey").cast("long").alias("grade"),
        F.get(steps, (F.col("c_custkey") % 4).cast("int")).alias("status"),
    )
    lines, parts = views.table(spark, d, "lineitem").where("l_quantity > 30"), views.table(spark, d, "part")
    selected = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("position"), F.col("p_brand").alias("subject"), F.col("p_size").cast("long").alias("grade"), (1 + F.col("p_size") % 5).alias("marks"),
    )
    requests = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("assessment_id"))
    return marking.papers(requests, selected, stored, ("draft", "review"))
