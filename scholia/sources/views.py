"""Driver tables and the views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
DAY_US = 86_400_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now_us(now: str = NOW):
    """Microseconds since 1970 of a wall time, read in the session's zone as the events' times are."""
    return F.expr(f"unix_micros(CAST(TIMESTAMP_NTZ'{now}' AS TIMESTAMP))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learner events without a sequence number: the order of (t_us, event_id) is the log's order."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "answer").when(F.col("event_type") == "view", "watch").when(F.col("event_type") == "error", "affect").otherwise("session_end")
    affect = F.when(F.col("event_type") == "error", "frustrated").when(F.col("event_type") == "purchase", "happy").when(F.col("event_type") == "click", "engaged")
    levels = F.array(*[F.lit(x) for x in ("remember", "understand", "apply", "analyze", "evaluate", "create")])
    return raw.select(
        F.col("user_id").alias("learner_id"), "event_id", F.concat(F.lit("c"), k % 20).alias("concept_id"), kind.alias("kind"),
        F.when(kind == "answer", F.least(F.lit(1.0), F.col("value") / 250)).alias("outcome"), F.get(levels, k % 6).alias("bloom"),
        (1 + k % 5).cast("double").alias("difficulty"), affect.alias("affect"), F.col("value").alias("duration_sec"), "ts", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("t_us"),
    )


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seq, each learner's running number from 1."""
    order = Window.partitionBy("learner_id").orderBy("t_us", "event_id")
    return events(spark, sf_dir).withColumn("seq", F.row_number().over(order).cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive concepts of a learner: source, target, occurrences; no self loops."""
    order = Window.partitionBy("learner_id").orderBy("t_us", "event_id")
    steps = events(spark, sf_dir).select(F.col("concept_id").alias("source"), F.lead("concept_id").over(order).alias("target"))
    return steps.where("target IS NOT NULL AND source <> target").groupBy("source", "target").agg(F.count("*").alias("occurrences"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: id, document_id, page (five lines each), heading, text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("heading"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select(F.concat_ws(":", "document_id", "pos").alias("id"), "document_id", F.expr("1 + pos DIV 5").cast("long").alias("page"), "heading", "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded answers: student, assessment, concept, awarded, max_marks, gap."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select(
        F.col("o_custkey").alias("student"), F.date_format("o_orderdate", "yyyy-MM").alias("assessment"), F.col("p_brand").alias("concept"),
        F.col("l_quantity").cast("double").alias("awarded"), F.lit(50.0).alias("max_marks"), F.concat("l_returnflag", "l_linestatus").alias("gap"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question bank: id, chapter, marks, quality, difficulty, bloom, stem."""
    part = table(spark, sf_dir, "part")
    top = part.agg(F.max(F.col("p_retailprice").cast("double")).alias("top"))
    levels = F.array(*[F.lit(x) for x in ("remember", "understand", "apply", "analyze", "evaluate", "create")])
    ease = F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"))
    return part.crossJoin(F.broadcast(top)).select(  # one row
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("chapter"), (1 + F.col("p_size") % 5).cast("long").alias("marks"),
        (F.col("p_retailprice").cast("double") / F.col("top")).alias("quality"), F.get(ease, (F.col("p_size") % 3).cast("int")).alias("difficulty"),
        F.get(levels, (F.col("p_size") % 6).cast("int")).alias("bloom"), F.col("p_name").alias("stem"),
    )
