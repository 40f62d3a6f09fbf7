"""Memory models: FSRS-6 cards, forgetting, revision plans and day plans, for all learners at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import scales
from scholia.operators.learners import age_days, clip
from scholia.sources.views import DAY_US

W = scales.FSRS_WEIGHTS
DECAY = -W[20]
FACTOR = math.exp(math.log(0.9) / DECAY) - 1
S_MIN, S_MAX = 0.1, 36500.0


def grade(outcome: Column) -> Column:
    """Good from 0.5, hard from 0.3, else again."""
    return F.when(outcome >= 0.5, 3.0).when(outcome >= 0.3, 2.0).otherwise(1.0)


def curve(days: Column, stability: Column) -> Column:
    """Retrievability after some days."""
    return F.pow(1 + FACTOR * days / stability, F.lit(DECAY))


def days_to(retention: float, stability: Column) -> Column:
    return stability / FACTOR * (math.pow(retention, 1 / DECAY) - 1)


def _between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _first_stability(g: Column) -> Column:
    return F.greatest(F.lit(S_MIN), F.when(g == 1, W[0]).when(g == 2, W[1]).when(g == 3, W[2]).otherwise(W[3]))


def _first_difficulty(g: Column) -> Column:
    return _between(W[4] - F.exp((g - 1) * W[5]) + 1, 1.0, 10.0)


def _reviewed(s: Column, g: Column, t: Column) -> tuple[Column, Column]:
    """Difficulty and stability after a review with grade g at t_us."""
    fresh = s["reps"] == 0
    elapsed = F.greatest(F.lit(0.0), (t - s["last_us"]) / DAY_US)
    d, st = s["d"], F.when(fresh, 1.0).otherwise(s["s"])
    r = curve(elapsed, st)
    easy = min(10.0, max(1.0, W[4] - math.exp(3 * W[5]) + 1))
    moved = d - W[6] * (g - 3) * (10 - d) / 9
    difficulty = _between(W[7] * easy + (1 - W[7]) * moved, 1.0, 10.0)
    lapse = F.least(F.greatest(W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(st + 1, F.lit(W[13])) - 1) * F.exp((1 - r) * W[14]), F.lit(S_MIN)), st)
    growth = math.exp(W[8]) * (11 - d) * F.pow(st, F.lit(-W[9])) * (F.exp((1 - r) * W[10]) - 1) * F.when(g == 2, W[15]).otherwise(1.0) * F.when(g == 4, W[16]).otherwise(1.0)
    recalled = _between(st * (1 + growth), S_MIN, S_MAX)
    return F.round(F.when(fresh, _first_difficulty(g)).otherwise(difficulty), 8), F.round(F.when(fresh, _first_stability(g)).otherwise(F.when(g == 1, lapse).otherwise(recalled)), 8)


def same_day(stability: Column, g: Column) -> Column:
    """Stability after a repeat on the same day; no part of the cards' reviews."""
    gain = F.pow(stability, F.lit(-W[19])) * F.exp(W[17] * (g - 3 + W[18]))
    return _between(stability * F.when(g >= 2, F.greatest(gain, F.lit(1.0))).otherwise(gain), S_MIN, S_MAX)


def cards(events: DataFrame) -> DataFrame:
    """FSRS-6 card of each (learner, concept), folded over its events in the order of time.

    An answer is a review; a watch is a good review of a reviewed card and then keeps 0.4 of the stability. Nights between events
    (gaps of one to two days) strengthen by 4 % each, 30 % at most. Columns: difficulty, stability, reps, lapses, last_review_us, nights.
    A history is folded in one task; its size is that of one learner's events on one concept.
    """
    history = events.groupBy("learner_id", "concept_id").agg(F.array_sort(F.collect_list(F.struct("t_us", "seq", "kind", "outcome"))).alias("history"))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("reps"), F.lit(0).cast("long").alias("lapses"), F.lit(0).cast("long").alias("last_us"), F.lit(0).cast("long").alias("seen_us"), F.lit(0).cast("long").alias("nights"))

    def step(s: Column, x: Column) -> Column:
        answer = (x["kind"] == "answer") & x["outcome"].isNotNull()
        watch = x["kind"] == "watch"
        g = F.when(answer, grade(x["outcome"])).otherwise(3.0)
        d, st = _reviewed(s, g, x["t_us"])
        review = answer | (watch & (s["reps"] > 0))
        stability = F.when(review, st).otherwise(s["s"])
        gap = (x["t_us"] - s["seen_us"]) / DAY_US
        night = (s["seen_us"] > 0) & (gap >= 1) & (gap <= 2)
        return F.struct(
            F.when(review, d).otherwise(s["d"]).alias("d"), F.when(watch & (s["reps"] > 0), stability * 0.4).otherwise(stability).alias("s"),
            (s["reps"] + F.when(review, 1).otherwise(0)).cast("long").alias("reps"), (s["lapses"] + F.when(answer & (s["reps"] > 0) & (g == 1), 1).otherwise(0)).cast("long").alias("lapses"),
            F.when(review, x["t_us"]).otherwise(s["last_us"]).alias("last_us"), x["t_us"].alias("seen_us"), (s["nights"] + F.when(night, 1).otherwise(0)).cast("long").alias("nights"),
        )

    folded = history.select("learner_id", "concept_id", F.aggregate("history", zero, step).alias("c"))
    gain = F.least(F.pow(F.lit(1.04), F.col("c.nights")), F.lit(1.3))
    return folded.select("learner_id", "concept_id", F.col("c.d").alias("difficulty"), (F.col("c.s") * gain).alias("stability"), F.col("c.reps").alias("reps"), F.col("c.lapses").alias("lapses"), F.when(F.col("c.reps") > 0, F.col("c.last_us")).alias("last_review_us"), F.col("c.nights").alias("nights"))


def forecast(card: DataFrame, now: Column, horizons: tuple[int, ...] = (1, 5, 14, 30, 90), floor: float = 0.05) -> DataFrame:
    """Retention now and at horizons of days, and the days until 0.6 is left."""
    since = F.greatest(F.lit(0.0), age_days(now, F.col("last_review_us")))
    kept = lambda more: F.when(F.col("reps") > 0, F.greatest(F.lit(floor), curve(since + more, F.col("stability")))).otherwise(floor)
    return card.select("learner_id", "concept_id", "stability", "reps", kept(0).alias("retention"), *[kept(h).alias(f"retention_{h}") for h in horizons], F.when(F.col("reps") > 0, days_to(0.6, F.col("stability"))).otherwise(0.0).alias("days_until_forgotten"))


def revision(forecasts: DataFrame, mastered: DataFrame, *, minutes: int = 20, threshold: float = 0.6) -> DataFrame:
    """What each learner revises now: concepts under the threshold by urgency and mastery, as many as 5-minute blocks fit."""
    joined = forecasts.join(mastered.select("learner_id", "concept_id", "mastery"), ["learner_id", "concept_id"])
    due = joined.where(F.col("retention") < threshold).withColumn("priority", clip((threshold - F.col("retention")) / threshold) * (0.5 + 0.5 * F.col("mastery")))
    order = Window.partitionBy("learner_id").orderBy(F.desc(F.round("priority", 4)), "concept_id")
    return due.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= minutes // 5).select("learner_id", "concept_id", "retention", "priority", "rank")


def exponential(events: DataFrame, now: Column, *, growth: float = 2.2, sensitivity: float = 0.8, floor: float = 0.05) -> DataFrame:
    """Strength in days from 1: right answers multiply it by `growth`, wrong ones by e^-sensitivity; e^(-days/strength) is left since the last event."""
    factor = F.when(F.expr("kind = 'answer' AND outcome IS NOT NULL"), F.when(F.col("outcome") >= 0.5, math.log(growth)).otherwise(-sensitivity)).otherwise(0.0)
    out = events.groupBy("learner_id", "concept_id").agg(F.exp(F.sum(factor)).alias("strength"), F.max_by("t_us", "seq").alias("last_us"))
    return out.select("learner_id", "concept_id", "strength", F.greatest(F.lit(floor), F.exp(-age_days(now, F.col("last_us")) / F.col("strength"))).alias("retention"))


def day_plan(forecasts: DataFrame, efficacy: DataFrame, mastered: DataFrame, *, capacity: int = 30) -> DataFrame:
    """Each learner's blocks of five minutes: practice, retrieve, review or recap by retention and confidence; what fits by priority and kind."""
    joined = forecasts.join(efficacy.select("learner_id", "concept_id", "verdict"), ["learner_id", "concept_id"]).join(mastered.select("learner_id", "concept_id", "confident"), ["learner_id", "concept_id"])
    r = F.col("retention")
    urgency = F.least(F.lit(1.0), (0.35 - r) / 0.35)
    sure = (F.col("verdict") == "overconfident") & F.col("confident")
    kind = F.when(r < 0.35, F.when(sure, "practice").otherwise("retrieve")).when(r < 0.6, "review").otherwise("recap")
    priority = F.when(r < 0.35, F.when(sure, 85.0).otherwise(90.0) + 5 * urgency).when(r < 0.6, 40 + (1 - r)).otherwise(0.0)
    weight = F.when(F.col("kind") == "retrieve", 1.6).when(F.col("kind") == "practice", 1.4).when(F.col("kind") == "review", 1.0).otherwise(0.8)
    blocks = joined.select("learner_id", "concept_id", kind.alias("kind"), priority.alias("priority")).where("kind <> 'recap'")
    order = Window.partitionBy("learner_id").orderBy(F.desc(F.round(F.col("priority") * weight, 6)), "concept_id")
    return blocks.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= capacity // 5)
