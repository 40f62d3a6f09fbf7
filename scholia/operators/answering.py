"""Answers that are put together from hits: quoted passages with citations, a critic's choice among them, marking schemes, sections of papers.

Hits are (query_id, id, rank) of any search, at most a stated number a query; chunks have unique ids. Texts of chunks that are no hit are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import scales
from scholia.functions import text as X

# Hits that a doubt is given, passages that its answer quotes, hits that count as evidence; a quotation's length.
HITS, QUOTED, EVIDENCE, QUOTE = 8, 3, 5, 400
# What a critic's words are worth, and the weights of relevance, support and utility.
SUPPORT = {"full": 1.0, "partial": 0.5, "none": 0.0}
UTILITY = {1: -1.0, 2: -0.5, 3: 0.0, 4: 0.5, 5: 1.0}
RELEVANCE_WEIGHT, SUPPORT_WEIGHT, UTILITY_WEIGHT = 1.0, 1.0, 0.5
NOTHING = "The documents say nothing on this."
NEEDLESS = "This needs no documents."


def _shown(hits: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    return hits.where(F.col("rank") <= most).select("query_id", "id", "rank").join(chunks.select("id", "document_id", "page", "heading", "text"), "id")


def _place(h: Column) -> Column:
    return F.concat(h["document_id"].cast("string"), F.lit(" p."), F.coalesce(h["page"].cast("string"), F.lit("?")))


def solved(hits: DataFrame, doubts: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, answer, citations, evidence, cited of every doubt (query_id).

    The answer quotes the first three hits, numbered; citations are the places and headings of all eight, evidence the places of the first five, each
    joined in the order of rank. A doubt without hits says so and cites nothing; a chunk's null heading or text counts as empty, a null page as `?`.
    """
    row = F.struct("rank", "document_id", "page", F.coalesce("heading", F.lit("")).alias("heading"), F.substring(F.coalesce("text", F.lit("")), 1, QUOTE).alias("text"))
    found = _shown(hits, chunks, HITS).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    quoted = F.transform(F.slice("hits", 1, QUOTED), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), _place(h), F.lit(") "), h["text"]))
    cited = F.transform("hits", lambda h: F.concat(_place(h), F.lit(" "), h["heading"]))
    joined = doubts.select("query_id").join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))
    return joined.select(
        "query_id", F.when(F.size("hits") > 0, F.array_join(quoted, "\n\n")).otherwise(NOTHING).alias("answer"), F.array_join(cited, "; ").alias("citations"),
        F.array_join(F.transform(F.slice("hits", 1, EVIDENCE), _place), "; ").alias("evidence"), F.size("hits").cast("long").alias("cited"),
    )


def lexical_verdicts(hits: DataFrame, doubts: DataFrame, chunks: DataFrame, paths: int = QUOTED) -> DataFrame:
    """query_id, id, relevant, support, utility of the first hits, from the share of a doubt's keywords among a passage's tokens: a critic without a model."""
    keys = doubts.select("query_id", F.array_distinct(X.keywords(F.col("query"))).alias("keys"))
    said = _shown(hits, chunks, paths).join(keys, "query_id").withColumn("n", F.size(F.array_intersect("keys", X.tokens(F.coalesce("text", F.lit(""))))))
    most = F.size("keys")
    support = F.when((most > 0) & (F.col("n") == most), "full").when(F.col("n") > 0, "partial").otherwise("none")
    return said.select("query_id", "id", (F.col("n") > 0).alias("relevant"), support.alias("support"), (1 + F.least(F.lit(4), F.col("n"))).cast("int").alias("utility"))


def reflected(hits: DataFrame, doubts: DataFrame, chunks: DataFrame, verdicts: DataFrame, needed: DataFrame | None = None, paths: int = QUOTED) -> DataFrame:
    """query_id, outcome, document_id, page, score, paths, answer: the passage of a doubt that a critic weighs most.

    verdicts: query_id, id, relevant, support (full, partial, none), utility (1 to 5), one row a pair; a passage without one is half relevant, half
    supported and of no utility, an unknown support counts as none and an unknown utility as 3. needed: query_id, retrieve; doubts that need no
    documents get none. Of equal scores the smaller rank wins. paths: places with scores, best first.
    """
    told = verdicts.select("query_id", "id", "relevant", "support", "utility", F.lit(True).alias("told"))
    relevance = F.when(F.col("told"), F.coalesce(F.col("relevant").cast("int"), F.lit(0)).cast("double")).otherwise(0.5)
    support = F.when(F.col("told"), scales.looked_up(F.lower("support"), SUPPORT, 0.0)).otherwise(0.5)
    utility = F.when(F.col("told"), scales.looked_up(F.col("utility"), UTILITY, 0.0)).otherwise(0.0)
    score = RELEVANCE_WEIGHT * relevance + SUPPORT_WEIGHT * support + UTILITY_WEIGHT * utility
    row = F.struct((-F.col("score")).alias("order"), "rank", "document_id", "page", "score", F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("text"))
    weighed = _shown(hits, chunks, paths).join(told, ["query_id", "id"], "left").withColumn("score", score)
    found = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    asked = doubts.select("query_id").join(found, "query_id", "left")
    asked = asked.withColumn("retrieve", F.lit(True)) if needed is None else asked.join(needed.select("query_id", "retrieve"), "query_id", "left").fillna(True, ["retrieve"])
    best = F.when(F.col("retrieve"), F.get("p", 0))
    outcome = F.when(~F.col("retrieve"), "needless").when(best.isNull(), "nothing").otherwise("answered")
    answer = F.when(outcome == "needless", NEEDLESS).when(outcome == "nothing", NOTHING).otherwise(F.concat(F.lit("["), _place(best), F.lit("] "), best["text"]))
    shown = F.array_join(F.transform("p", lambda h: F.concat(_place(h), F.lit(" "), F.format_number(h["score"], 3))), "; ")
    return asked.select(
        "query_id", outcome.alias("outcome"), best["document_id"].alias("document_id"), best["page"].alias("page"), F.round(best["score"], 3).alias("score"),
        F.when(outcome == "answered", shown).otherwise("").alias("paths"), answer.alias("answer"),
    )


def schemes(hits: DataFrame, chunks: DataFrame, word: str = "marking", most: int = EVIDENCE, among: int = HITS) -> DataFrame:
    """query_id, rank, id, document_id, page, heading: the first hits whose document or heading has the word; of a query without such hits, its first ones."""
    named = F.contains(F.lower(F.concat_ws(" ", F.col("document_id").cast("string"), "heading")), F.lit(word.lower()))
    rows = _shown(hits, chunks, among).withColumn("named", named)
    kept = rows.withColumn("any", F.max("named").over(Window.partitionBy("query_id"))).where(F.col("named") | ~F.col("any"))
    placed = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return placed.where(F.col("rank") <= most).select("query_id", "rank", "id", "document_id", "page", "heading")


def sections(hits: DataFrame, chunks: DataFrame, among: int = 10, length: int = 120) -> DataFrame:
    """query_id, heading, place, hits, texts: the headings under which a paper's hits stand, in the order of their first one, with the beginnings of the texts. Hits without a heading have no section."""
    rows = _shown(hits, chunks, among).where("heading <> ''")
    held = rows.groupBy("query_id", "heading").agg(F.min("rank").alias("first"), F.count("*").alias("hits"), F.array_sort(F.collect_list(F.struct("rank", F.substring(F.coalesce("text", F.lit("")), 1, length).alias("text")))).alias("texts"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long")
    return held.select("query_id", "heading", place.alias("place"), "hits", F.array_join(F.transform("texts", lambda t: t["text"]), " | ").alias("texts"))
