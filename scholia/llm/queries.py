"""The thin queries opN_<name> over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import content_sort, context_tree, language_id, personal_data, piece_codec, pivot_search, simhash, templates, token_counts, toxicity, turn_repair, url_rules, yinyang
from scholia.llm._spark import fold, table


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree score of every text beside a unigram base; learns from ids whose crc32 modulo 10 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    model = context_tree.fit(docs, "text", ~held_out)
    scored = context_tree.score(docs, "text", "doc_id", model, covered=True)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold("id", 10) == 0, F.lit(False)).alias("held_out"),
        F.col("words").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("total").alias("score"),
        "n_bytes",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learns from ids whose crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold("doc_id", 5) != 0), "text", "lang")
    predicted = language_id.predict(docs, "text", "doc_id", model)
    return predicted.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the URL rules on every page."""
    literals = F.array(*(F.struct(*(F.lit(x).alias(name) for x, name in zip(rule, ("host", "path", "verdict"), strict=True))) for rule in URL_RULES))
    rules = spark.range(1).select(F.explode(literals).alias("rule")).select("rule.*")
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), "url", rules).drop("url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learns from ids whose crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learning = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learning), "text", "doc_id", table(spark, sf_dir, "labels").where(learning), "toxic")
    scored = toxicity.score(docs, "text", "doc_id", model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, with the covered share of the item."""
    found = templates.leaks(table(spark, sf_dir, "documents"), "text", "doc_id", table(spark, sf_dir, "benchmark"), "text", "item_id")
    return found.withColumnRenamed("id", "doc_id")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the same bytes (U+2581 read as a space)."""
    encoded = piece_codec.encode(table(spark, sf_dir, "documents"), "text", "doc_id")
    return encoded.select(F.col("id").alias("doc_id"), F.col("ids").alias("token_ids"), "n_tokens", "exact")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every text, and the smallest doc_id that links at up to 4 bits reach."""
    groups = simhash.grouped(table(spark, sf_dir, "documents"), "text", "doc_id")
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of every vector whose id is divisible by 50."""
    return pivot_search.top(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", F.col("vec_id") % 50 == 0, 5)


#: Tokens of a context.
LIMIT = 4096


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every text with the 32k vocabulary."""
    counted = token_counts.counts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text: the base ones as a digest, and all of them."""
    spans = personal_data.found(table(spark, sf_dir, "documents"), "text", "doc_id")
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in personal_data.KINDS]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(personal_data._joined("base"), 256).alias("base_sha256"), personal_data._joined("concat(base, added)").alias("spans"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after 5 exact rounds over 40 centroids, with distances and inertia."""
    found, centroids = yinyang.clustered(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return yinyang.report(found, centroids).withColumnRenamed("id", "vec_id")


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents: the row that stays, the size of the group, the digest of the text."""
    return content_sort.grouped(table(spark, sf_dir, "documents"), "text", "doc_id").withColumnRenamed("id", "doc_id")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, after planted damage."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = turn_repair.damaged(told, "conv_id", "turn", "role", "text")
    found = turn_repair.digests(turn_repair.repaired(damaged, "conv", "turn", "role", "text"))
    every = told.select("conv_id").distinct()
    sums = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce(F.col("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), digest)


QUERIES = {f.__name__: f for f in (op1_context_tree, op2_language_id, op3_url_rules, op4_toxicity, op5_templates, op6_piece_codec, op7_simhash, op8_pivot_search, op9_token_counts, op10_personal_data, op11_yinyang, op12_content_sort, op13_turn_repair)}
