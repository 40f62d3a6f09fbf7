"""Retrieval over chunks (id, document_id, page, heading, text): an inverted index as a table, and rankings from it.

Only the queries' tokens are grouped and shuffled: each chunk's tokens meet the queries' in a join before anything is
counted (Spark broadcasts the queries' side while it is small, and shuffles beyond). Statistics are plain aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as X

K1, B = 1.2, 0.75


def _query(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, token, qtf: few rows a query."""
    toks = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("token"))
    return toks.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def ranked(scored: DataFrame, limit: int, key: str = "id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def _tokenised(chunks: DataFrame) -> DataFrame:
    """id, document_id, tokens of heading and text together."""
    return chunks.select("id", "document_id", X.tokens(F.concat_ws(" ", "heading", "text")).alias("tokens"))


def hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, token, id, length, tf of the chunks that hold a query's token."""
    asked = _query(chunks, queries)
    listed = _tokenised(chunks).select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    found = listed.join(asked.select("token").distinct(), "token").groupBy("token", "id", "length").agg(F.count("*").alias("tf"))
    return found.join(asked, "token")


def bm25(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, id, score, rank by BM25 over any of a query's tokens (k1 1.2, b 0.75, idf at least 1e-6)."""
    whole = _tokenised(chunks).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    found = hits(chunks, queries)
    df = found.groupBy("query_id", "token").agg(F.count("*").alias("df"))
    joined = found.join(df, ["query_id", "token"]).crossJoin(F.broadcast(whole))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return ranked(joined.groupBy("query_id", "id").agg(F.sum(part).alias("score")), limit)


def tfidf_documents(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, document_id, score, rank: document vectors of unit length, df by chunk, idf smoothed by the number of documents.

    A document's tokens come together once, where its norm and its counts of the queries' tokens are made in the same pass.
    """
    asked = _query(chunks, queries)
    wanted = asked.select("token", F.lit(True).alias("wanted")).distinct()
    counts = _tokenised(chunks).repartition("document_id").select("document_id", F.explode("tokens").alias("token")).groupBy("document_id", "token").agg(F.count("*").alias("tf"))
    marked = counts.join(wanted, "token", "left")
    documents = marked.groupBy("document_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"), F.collect_list(F.when(F.col("wanted"), F.struct("token", "tf"))).alias("held"))
    listed = documents.where(F.size("held") > 0).select("document_id", "norm", F.explode("held").alias("x")).select("document_id", "norm", "x.*")
    df = _tokenised(chunks).select(F.explode(F.array_distinct("tokens")).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("df"))
    count = chunks.agg(F.count_distinct("document_id").alias("d"))
    joined = listed.join(asked, "token").join(df, "token").crossJoin(F.broadcast(count))  # one row
    part = F.col("qtf") * F.col("tf") / F.col("norm") * (F.log((F.col("d") + 1) / (F.col("df") + 1)) + 1)
    return ranked(joined.groupBy("query_id", "document_id").agg(F.sum(part).alias("score")), limit, "document_id")


def tfidf(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """The first three chunks of each of the best documents: query_id, id, score, rank."""
    docs = tfidf_documents(chunks, queries, limit)
    order = Window.partitionBy("document_id").orderBy(F.split("id", ":")[1].cast("long"))
    first = chunks.join(docs.select("document_id").distinct(), "document_id").withColumn("pos", F.row_number().over(order)).where("pos <= 3").select("document_id", "id", "pos")
    joined = docs.select("query_id", "document_id", "score", F.col("rank").alias("doc_rank")).join(first, "document_id")
    rank = Window.partitionBy("query_id").orderBy("doc_rank", "pos")
    return joined.withColumn("rank", F.row_number().over(rank).cast("long")).select("query_id", "id", "score", "rank")


def rrf(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, score: sums of 1/(k + rank)."""
    merged = rankings[0].select("query_id", "id", "rank")
    for other in rankings[1:]:
        merged = merged.unionByName(other.select("query_id", "id", "rank"))
    return merged.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def hybrid(chunks: DataFrame, queries: DataFrame, limit: int = 12, *, linked: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """BM25 and TF-IDF fused, and 0.15 for each of the query's keywords that a chunk holds: query_id, id, score, rank.

    linked (document_id): documents whose node has a neighbour; their chunks get 0.1 more. anchors (query_id, id): the
    query's concepts in the graph; with any, its first `limit` chunks get 0.05 for each, at most 0.2.
    """
    fused = rrf(bm25(chunks, queries, 2 * limit), tfidf(chunks, queries, 2 * limit))
    keys = queries.select("query_id", X.keywords(F.col("query")).alias("keywords"))
    texts = fused.join(chunks.select("id", "document_id", F.lower(F.concat_ws(" ", "heading", "text")).alias("low")), "id").join(keys, "query_id")
    boost = 0.15 * F.size(F.filter("keywords", lambda w: F.contains(F.col("low"), w)))
    scored = texts.select("query_id", "id", "document_id", F.col("score").alias("fused"), (F.col("score") + boost).alias("score"))
    if linked is not None:
        near = linked.select("document_id", F.lit(0.1).alias("near")).distinct()
        scored = scored.join(near, "document_id", "left").withColumn("score", F.col("score") + F.coalesce("near", F.lit(0.0)))
    if anchors is not None:
        extra = anchors.groupBy("query_id").agg(F.least(F.lit(0.2), 0.05 * F.count_distinct("id")).alias("extra"))
        first = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "id")  # as fused, before the other boosts
        scored = scored.join(extra, "query_id", "left").withColumn("place", F.row_number().over(first))
        scored = scored.withColumn("score", F.col("score") + F.when(F.col("place") <= limit, F.coalesce("extra", F.lit(0.0))).otherwise(0.0))
    return ranked(scored.select("query_id", "id", "score"), limit)


def heading_prior(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits with 0.1 more for each query word of over 3 characters in the heading, ranked anew."""
    found = F.filter(F.split(F.lower("query"), " "), lambda w: (F.length(w) > 3) & F.contains(F.lower(F.col("heading")), w))
    joined = hits.drop("rank").join(chunks.select("id", "heading"), "id").join(queries, "query_id")
    return ranked(joined.select("query_id", "id", (F.col("score") + 0.1 * F.size(found)).alias("score")), 1 << 30)


def phrase_hits(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, id, document_id of each chunk whose heading or text holds a phrase's tokens in a row.

    Runs of as many tokens as some phrase has are the key of an equi-join; the lengths of the phrases are few.
    """
    asked = phrases.select("phrase", X.tokens(F.col("phrase")).alias("t")).where(F.size("t") > 0).select("phrase", F.size("t").alias("n"), F.array_join("t", " ").alias("run"))
    lengths = asked.agg(F.array_sort(F.collect_set("n")).alias("ns"))
    runs = lambda t: F.flatten(F.transform("ns", lambda n: F.transform(F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(t, i, n), " "))))
    texts = chunks.select("id", "document_id", X.tokens(F.col("text")).alias("t"), X.tokens(F.coalesce("heading", F.lit(""))).alias("h")).crossJoin(F.broadcast(lengths))  # one row
    listed = texts.select("id", "document_id", F.explode(F.array_distinct(F.concat(runs(F.col("t")), runs(F.col("h"))))).alias("run"))
    return listed.join(asked.select("phrase", "run"), "run").select("phrase", "id", "document_id").distinct()


def metrics(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG (linear gain) at k for each query. ranking: query_id, id, rank; relevant: query_id, id, gain."""
    judged = ranking.join(relevant, ["query_id", "id"], "left")
    top = F.col("rank") <= k
    hit = F.col("gain") > 0
    got = judged.groupBy("query_id").agg(
        F.count_if(top & hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(top, F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")
    best = relevant.withColumn("r", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.count_if(hit).alias("n"), F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg"))
    joined = got.join(ideal, "query_id", "left")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return joined.select("query_id", (F.col("hits") / k).alias("precision"), over(F.col("hits"), F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), over(F.col("dcg"), F.col("idcg")).alias("ndcg"))
