"""States of streamed cards: one for each learner, whatever the number of concepts."""

from pyspark.sql import functions as F

from scholia.streaming import cards, replay


def test_concepts_of_a_learner_share_a_state(spark, tmp_path):
    n = F.col("id")
    kind = F.when(n % 3 == 0, "affect").otherwise("answer")
    events = spark.range(120).select(
        (n % 2).alias("learner_id"), F.when(n % 20 > 1, F.concat(F.lit("c"), n % 20)).alias("concept_id"), n.alias("event_id"), kind.alias("kind"), F.lit(1.0).alias("outcome"), F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600).alias("ts")
    ).withColumn("t_us", F.unix_micros("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = replay.read(spark, f"{tmp_path}/in", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    q = replay.to_table(cards.replayed(stream, "1 day"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 2
    got = replay.current(spark, f"{tmp_path}/out", ["learner_id", "concept_id"]).collect()
    assert len(got) == 20 and sum(r.reps for r in got) == 80 and sum(r.concept_id is None for r in got) == 2
