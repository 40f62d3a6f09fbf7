"""Incremental replay of learner events.

Batches of an append-only log update each (learner, concept): a running aggregation with the same columns as the batch
operator, and windows for sessions and rolling activity. Sinks are idempotent by batch: a batch that is run again writes the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "learner_id long, event_id long, concept_id string, kind string, outcome double, affect string, ts timestamp"


def read(spark: SparkSession, path: str, schema: str = EVENTS, files_a_batch: int = 16) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each event once, also where a source repeats it within the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def replayed(events: DataFrame) -> DataFrame:
    """attempts, correct and last_seen of each (learner, concept), for update or complete mode.

    Its state is a row for each (learner, concept) of the log, for as long as the log runs: that is its result, and nothing expires. Chain `once`
    before it where a source repeats events; `recent` keeps state for a bounded time.
    """
    right = (F.col("kind") == "answer") & (F.col("outcome") >= 0.5)
    return events.groupBy("learner_id", "concept_id").agg(F.count("*").alias("attempts"), F.count_if(right).alias("correct"), F.max("ts").alias("last_seen"))


def recent(events: DataFrame, width: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """The same by spans of `width`, each event once: a span's state goes when the watermark passes its end (append mode). Spans add up to the whole."""
    right = (F.col("kind") == "answer") & (F.col("outcome") >= 0.5)
    out = once(events, lateness).groupBy("learner_id", "concept_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("attempts"), F.count_if(right).alias("correct"), F.max("ts").alias("last_seen"))
    return out.select("learner_id", "concept_id", F.col("w.start").alias("start"), "attempts", "correct", "last_seen")


def sessions(events: DataFrame, gap: str = "2 hours", lateness: str = "1 day") -> DataFrame:
    """Sessions of each learner that end after a gap; final ones only (append mode)."""
    out = events.withWatermark("ts", lateness).groupBy("learner_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("learner_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def rolling(events: DataFrame, width: str = "7 days", slide: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events and right answers of each learner in sliding windows."""
    right = (F.col("kind") == "answer") & (F.col("outcome") >= 0.5)
    out = events.withWatermark("ts", lateness).groupBy("learner_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("events"), F.count_if(right).alias("correct"))
    return out.select("learner_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "correct")


def to_table(changes: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes each batch's changed rows below path/batch=N; running a batch again replaces its folder."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key over all batches."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")
