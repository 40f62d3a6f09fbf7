"""Models of learners, over all learners at once. Events have learner_id, concept_id, kind, outcome, bloom, affect, t_us, and seq where order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import scales
from scholia.sources.views import DAY_US

def answer() -> Column:
    return F.col("kind") == "answer"


def right() -> Column:
    return answer() & (F.col("outcome") >= 0.5)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def age_days(now: Column, at: Column) -> Column:
    return (now - at) / DAY_US


def ratio(a: Column, b: Column, other: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(other)


def stats(events: DataFrame) -> DataFrame:
    """Counts of each learner's events by kind, answers and right ones, first and last time."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("answer", "watch", "affect", "session_end")]
    return events.groupBy("learner_id").agg(F.count("*").alias("events"), F.count_if(right()).alias("correct"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count_distinct("concept_id").alias("concepts"), *kinds)


def replay(events: DataFrame) -> DataFrame:
    """State of each (learner, concept): attempts of all kinds, right answers, time of the last recorded event."""
    return events.groupBy("learner_id", "concept_id").agg(F.count("*").alias("attempts"), F.count_if(right()).alias("correct"), F.max_by("t_us", "seq").alias("last_seen_us"))


def mastery(events: DataFrame, now: Column, *, recency_days: float = 7.0, retention_days: float = 14.0) -> DataFrame:
    """Mastery of each (learner, concept): accuracy, recency-weighted confidence, retention and application, weighed; unrounded."""
    age = age_days(now, F.col("t_us"))
    weight = F.when(answer(), F.exp(-age / recency_days))
    applied = F.when(F.col("bloom").isin(*scales.APPLICATION), F.col("outcome"))
    sums = events.groupBy("learner_id", "concept_id").agg(
        F.count("*").alias("attempts"), F.count_if(right()).alias("correct"), F.count_if(answer()).alias("answers"), F.max_by("t_us", "seq").alias("last_us"),
        F.sum(weight).alias("w"), F.sum(weight * F.col("outcome")).alias("wo"), F.avg(applied).alias("app"),
    )
    accuracy = F.col("correct") / F.col("attempts")
    confidence = F.when(F.col("w") > 0, clip(F.col("wo") / F.col("w"))).otherwise(accuracy)
    retention = F.greatest(F.lit(0.1), F.exp(-age_days(now, F.col("last_us")) / retention_days))
    application = clip(F.coalesce("app", F.lit(0.0)))
    parts = sums.select("learner_id", "concept_id", "attempts", accuracy.alias("accuracy"), confidence.alias("confidence"), retention.alias("retention"), application.alias("application"), (F.col("answers") >= 3).alias("confident"))
    return parts.withColumn("mastery", clip(0.25 * F.col("accuracy") + 0.25 * F.col("confidence") + 0.30 * F.col("retention") + 0.20 * F.col("application")))


def status(mastered: DataFrame, *, target: float = 0.85, weak: float = 0.55) -> DataFrame:
    """Five-way status of each concept."""
    m = F.col("mastery")
    label = F.when(~F.col("confident"), "learning").when(m >= target, "mastered").when(m >= 0.7, "proficient").when(m >= weak, "developing").otherwise("needsReview")
    return mastered.withColumn("status", label)


def weakest(mastered: DataFrame, n: int, *, weak: float = 0.55) -> DataFrame:
    """Each learner's n weakest concepts under the threshold."""
    order = Window.partitionBy("learner_id").orderBy("mastery", "concept_id")
    return mastered.where(F.col("mastery") < weak).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def emotions(events: DataFrame) -> DataFrame:
    """Valence and arousal of each learner and of each (learner, concept) (concept null: over all), share of positive events, the tag that has 60 % of the tagged."""
    tag = F.trim(F.lower("affect"))
    tagged = events.select("learner_id", "concept_id", F.when(tag != "", tag).alias("tag"))
    counts = tagged.groupBy("learner_id", "concept_id", "tag").agg(F.count("*").alias("n"))  # a row for each tag: what follows is small
    valence, arousal = scales.looked_up(F.col("tag"), scales.VALENCE, scales.DEFAULT_VALENCE), scales.looked_up(F.col("tag"), scales.AROUSAL, scales.DEFAULT_AROUSAL)
    levels = counts.withColumns({"v": valence, "a": arousal}).rollup("learner_id", "concept_id", "tag").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("v")) / F.sum("n"), 9).alias("valence"), F.round(F.sum(F.col("n") * F.col("a")) / F.sum("n"), 9).alias("arousal"),
        (F.sum(F.when(F.col("v") >= scales.POSITIVE, F.col("n")).otherwise(0)) / F.sum("n")).alias("positive_ratio"), F.grouping_id().alias("g"),
    )
    whole = levels.where("g IN (1, 3)").drop("tag", "g")
    most = tagged.where("tag IS NOT NULL").groupBy("learner_id", "concept_id", "tag").agg(F.count("*").alias("n"))
    most = most.unionByName(most.groupBy("learner_id", "tag").agg(F.sum("n").alias("n")).withColumn("concept_id", F.lit(None).cast("string")))
    top = most.groupBy("learner_id", "concept_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("top"), F.sum("n").alias("all"))
    dominant = top.where(-F.col("top.m") / F.col("all") >= 0.6).select(F.col("learner_id").alias("l"), F.col("concept_id").alias("c"), F.col("top.tag").alias("dominant"))
    joined = whole.join(dominant, (F.col("learner_id") == F.col("l")) & F.col("concept_id").eqNullSafe(F.col("c")), "left")
    return joined.select("learner_id", "concept_id", F.col("n").cast("long").alias("n"), "valence", "arousal", "positive_ratio", "dominant")


def _profile(now: Column, inside: Column, name: str) -> list[Column]:
    """Sums behind one motivation profile, over the events that `inside` holds for."""
    age = age_days(now, F.col("t_us"))
    w = F.exp(-age / 7.0)
    valence = scales.looked_up(F.trim(F.lower("affect")), scales.VALENCE, scales.DEFAULT_VALENCE)
    answered = inside & answer() & F.col("outcome").isNotNull()
    recent = inside & (age <= 14) & (age >= 0)
    day = F.floor(F.col("t_us") / DAY_US)
    return [
        F.count_if(answered).alias(f"{name}_n"), F.sum(F.when(answered, w)).alias(f"{name}_w"), F.sum(F.when(answered, w * F.col("outcome"))).alias(f"{name}_wo"),
        F.sum(F.when(inside, w)).alias(f"{name}_ww"), F.sum(F.when(inside, w * valence)).alias(f"{name}_wv"), F.count_distinct(F.when(recent, day)).alias(f"{name}_days"),
        (F.max(F.when(recent, day)) - F.min(F.when(recent, day))).alias(f"{name}_span"),
    ]


def _motivated(name: str) -> dict[str, Column]:
    n, days, span = F.col(f"{name}_n"), F.col(f"{name}_days"), F.col(f"{name}_span")
    accuracy = F.when(F.col(f"{name}_w") > 0, F.col(f"{name}_wo") / F.col(f"{name}_w")).otherwise(0.5)
    trust = F.least(F.lit(1.0), n / 5)
    competence = trust * accuracy + (1 - trust) * 0.5
    persistence = F.when(days <= 1, 0.0).otherwise(clip(days / 14 * (days - 1) / F.greatest(F.lit(1), span)))
    valence = F.when(F.col(f"{name}_ww") > 0, F.col(f"{name}_wv") / F.col(f"{name}_ww")).otherwise(scales.DEFAULT_VALENCE)
    engagement = 0.6 * valence * (0.5 + 0.5 * persistence) + 0.4 * accuracy
    score = F.when(F.col(f"{name}_ww").isNull(), 0.5).otherwise(clip(0.4 * competence + 0.4 * engagement + 0.2 * persistence))
    return {"competence": competence, "persistence": persistence, "valence": valence, "engagement": engagement, "score": score}


def motivation(events: DataFrame, now: Column) -> DataFrame:
    """Each learner's competence, persistence, engagement, score and type, and the trend between the last two weeks."""
    age = age_days(now, F.col("t_us"))
    windows = {"all": F.lit(True), "new": (age >= 0) & (age <= 7), "old": (age > 7) & (age <= 14)}
    sums = events.groupBy("learner_id").agg(*[c for name, inside in windows.items() for c in _profile(now, inside, name)])
    out = sums.select("learner_id", *[c.alias(k) for k, c in _motivated("all").items()], (_motivated("new")["score"] - _motivated("old")["score"]).alias("trend"))
    kind = F.when(F.col("score") >= 0.6, "intrinsic").when(F.col("score") >= 0.35, "extrinsic").otherwise("fragile")
    return out.withColumns({"type": kind, "intrinsic": (F.col("persistence") > 0.7) & (F.col("valence") > 0.6)})


def riasec(events: DataFrame, subjects: DataFrame) -> DataFrame:
    """RIASEC shares of each learner, and the three-letter code. subjects: concept_id, subject."""
    rows = []
    for subject, weights in scales.SUBJECT_RIASEC.items():
        rows += [(subject, d, weights.get(d, 0.0)) for d in scales.RIASEC]
    spark = events.sparkSession
    vectors = F.broadcast(spark.createDataFrame(rows, "subject string, dimension string, weight double"))
    weight = F.when(F.coalesce("duration_sec", F.lit(0.0)) <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.col("duration_sec") / 60))
    by_concept = events.groupBy("learner_id", "concept_id").agg(F.sum(weight).alias("evidence"))
    named = by_concept.join(subjects, "concept_id", "left").groupBy("learner_id", "subject").agg(F.sum("evidence").alias("evidence"))
    known = named.join(vectors, "subject")
    unknown = named.join(vectors.select("subject").distinct(), "subject", "left_anti").withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in scales.RIASEC]))).withColumn("weight", F.lit(1.0 / 6))
    raw = known.select("learner_id", "dimension", (F.col("evidence") * F.col("weight")).alias("x")).unionByName(unknown.select("learner_id", "dimension", (F.col("evidence") * F.col("weight")).alias("x")))
    sums = raw.groupBy("learner_id").agg(*[F.sum(F.when(F.col("dimension") == d, F.col("x")).otherwise(0.0)).alias(d.lower()) for d in scales.RIASEC])
    total = sum((F.col(d.lower()) for d in scales.RIASEC[1:]), F.col("realistic"))
    shares = sums.select("learner_id", total.alias("evidence"), *[(F.col(d.lower()) / total).alias(d.lower()) for d in scales.RIASEC])
    ranked = F.array_sort(F.array(*[F.struct((-F.round(F.col(d.lower()), 4)).alias("s"), F.lit(d).alias("d")) for d in scales.RIASEC]))
    return shares.withColumn("holland_code", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: F.substring(x["d"], 1, 1)), ""))


def academic_year(ts: Column) -> Column:
    """April to March: 2025-26."""
    start = F.year(ts) - F.when(F.month(ts) < 4, 1).otherwise(0)
    return F.format_string("%d-%02d", start, (start + 1) % 100)


def years(events: DataFrame) -> DataFrame:
    """Each learner's academic years: events, concepts, active days, answers, accuracy."""
    answered = answer() & F.col("outcome").isNotNull()
    out = events.withColumn("year", academic_year(F.col("ts"))).groupBy("learner_id", "year").agg(F.count("*").alias("events"), F.count_distinct("concept_id").alias("concepts"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.count_if(answered).alias("answers"), F.count_if(right()).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("answers"), F.lit(0.0)))


def continuity(events: DataFrame) -> DataFrame:
    """Concepts a learner meets in more than one period (calendar weeks where the log is within a year): first and last accuracy and the change."""
    answered = answer() & F.col("outcome").isNotNull()
    by = events.withColumn("period", F.floor(F.col("t_us") / (7 * DAY_US))).groupBy("learner_id", "concept_id", "period").agg(ratio(F.count_if(right()), F.count_if(answered), F.lit(0.0)).alias("accuracy"))
    out = by.groupBy("learner_id", "concept_id").agg(F.count("*").alias("periods"), F.min_by("accuracy", "period").alias("first_accuracy"), F.max_by("accuracy", "period").alias("last_accuracy"))
    return out.where("periods > 1").withColumn("improves", F.col("last_accuracy") - F.col("first_accuracy"))


def habits(events: DataFrame, now: Column) -> DataFrame:
    """Each learner's study days, streaks (gaps up to a day, a day of grace), consistency over 7 and 30 days, phase and risk."""
    today = F.floor(now / DAY_US)
    days = events.where(F.col("t_us") <= now).select("learner_id", F.floor(F.col("t_us") / DAY_US).alias("day")).distinct()
    order = Window.partitionBy("learner_id").orderBy("day")
    runs = days.withColumn("island", F.col("day") - F.row_number().over(order)).groupBy("learner_id", "island").agg(F.count("*").alias("length"), F.max("day").alias("last"), F.count_if(today - F.col("day") < 7).alias("d7"), F.count_if(today - F.col("day") < 30).alias("d30"))
    out = runs.groupBy("learner_id").agg(F.sum("length").alias("total_days"), F.max("length").alias("longest_streak"), F.max_by("length", "last").alias("run"), F.max("last").alias("last"), (F.sum("d7") / 7).alias("consistency_7"), (F.sum("d30") / 30).alias("consistency_30"))
    idle = today - F.col("last")
    phase = F.when(F.col("consistency_7") < 0.4, "relapse").when(F.col("total_days") <= 21, "forming").when(F.col("total_days") <= 66, "consolidating").otherwise("automated")
    return out.select("learner_id", "total_days", F.when(idle <= 1, F.col("run")).otherwise(0).alias("current_streak"), "longest_streak", "consistency_7", "consistency_30", phase.alias("phase"), F.greatest(1 - F.col("consistency_7"), F.least(idle / 3, F.lit(1.0))).alias("risk"))


def attention(events: DataFrame, *, minutes: float = 25.0, exponent: float = 1.7) -> DataFrame:
    """Attention through each learner's day: mean hazard so far, decay with the minutes since the day's first event, never rising."""
    session = events.withColumn("day", F.floor(F.col("t_us") / DAY_US))
    so_far = Window.partitionBy("learner_id", "day").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hazard = F.round(F.avg(scales.looked_up(F.trim(F.lower("affect")), scales.HAZARD, 1.0)).over(so_far), 4)
    elapsed = (F.col("t_us") - F.min("t_us").over(so_far)) / 60_000_000.0
    raw = session.select("learner_id", "day", "event_id", "t_us", hazard.alias("hazard"), elapsed.alias("minutes"))
    decayed = clip(1 - F.pow(F.col("minutes") / (F.lit(minutes) / F.col("hazard")), F.lit(exponent)))
    out = raw.withColumn("raw", decayed).withColumn("attention", F.min("raw").over(so_far))
    a = F.col("attention")
    verdict = F.when(a < 0.2, "fatigued").when(a < 0.5, "resting").when(a >= 0.7, "focused").otherwise("waning")
    return out.select("learner_id", "day", "event_id", "minutes", "hazard", "attention", verdict.alias("state"), (20 * F.greatest(0.7 - a, F.lit(0.0)) / 0.7).alias("rest_minutes"))


def self_efficacy(events: DataFrame, now: Column) -> DataFrame:
    """Self-efficacy of each (learner, concept): a base, then gains and losses by each answer in the order of seq, and its calibration."""
    w = F.when(answer(), F.exp(-age_days(now, F.col("t_us")) / 7.0))
    valence = scales.looked_up(F.trim(F.lower("affect")), scales.VALENCE, scales.DEFAULT_VALENCE)
    base = events.groupBy("learner_id", "concept_id").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("outcome")).alias("wo"), F.avg(valence).alias("affect"),
        F.array_sort(F.collect_list(F.when(answer() & F.col("outcome").isNotNull(), F.struct("seq", "outcome")))).alias("answers"),
    )
    accuracy = F.when(F.col("w") > 0, F.col("wo") / F.col("w")).otherwise(0.0)
    start = 0.5 * F.col("accuracy") + 0.2 * F.col("affect") + 0.15 * 0.5 + 0.15 * 0.5
    step = lambda e, x: F.when(x["outcome"] >= 0.5, e + 0.35 * (1 - e)).otherwise(e - 0.45 * e)
    out = base.withColumn("accuracy", accuracy).withColumn("efficacy", clip(F.aggregate("answers", start, step)))
    gap = F.col("efficacy") - F.col("accuracy")
    return out.select("learner_id", "concept_id", "accuracy", "affect", "efficacy", gap.alias("calibration"), F.when(gap >= 0.15, "overconfident").when(gap <= -0.15, "underconfident").otherwise("calibrated").alias("verdict"))


def curiosity(mastered: DataFrame, momentum: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """Each learner's n most curious concepts: novelty, difficulty near 0.65, other domains, recent success; mastered ones are left out.

    candidates: concept_id, difficulty (0 to 1), domain; a curriculum's, scales.MOST_FEW at most. momentum: learner_id, concept_id, momentum. The current domain is the learner's concept of most attempts.
    """
    learners = mastered.groupBy("learner_id").agg(F.max_by("concept_id", F.struct("attempts", "concept_id")).alias("current"))
    here = learners.join(candidates.select(F.col("concept_id").alias("current"), F.col("domain").alias("own_domain")), "current", "left")
    listed = scales.few(candidates).agg(F.collect_list(F.struct("concept_id", "difficulty", "domain")).alias("candidates"))
    pairs = here.crossJoin(F.broadcast(listed)).select("learner_id", "current", "own_domain", F.explode("candidates").alias("x")).select("learner_id", "current", "own_domain", "x.*")  # one row
    state = mastered.select("learner_id", "concept_id", "mastery").join(momentum, ["learner_id", "concept_id"], "left")
    rows = pairs.join(state, ["learner_id", "concept_id"], "left").where("mastery IS NULL OR mastery < 0.8")
    novel = F.col("mastery").isNull()
    z = (F.col("difficulty") - 0.65) / 0.15
    wanted = F.when((F.col("difficulty") < 0.5) | (F.col("difficulty") > 0.85), 0.0).otherwise(F.exp(-0.5 * z * z))
    other = F.coalesce((F.col("domain") != F.col("own_domain")).cast("double"), F.lit(0.0))
    score = clip(F.when(novel, 0.35 + 0.2).otherwise(-0.2) + 0.35 * wanted + 0.15 * other + 0.15 * F.coalesce("momentum", F.lit(0.5)))
    order = Window.partitionBy("learner_id").orderBy(F.desc(F.round("score", 4)), "concept_id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("learner_id", "concept_id", "score", "rank")


def momentum(events: DataFrame, last: int = 5) -> DataFrame:
    """Share of right answers among the last ones of each (learner, concept)."""
    order = Window.partitionBy("learner_id", "concept_id").orderBy(F.desc("seq"))
    recent = events.where("kind = 'answer' AND outcome IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= last)
    return recent.groupBy("learner_id", "concept_id").agg(F.avg((F.col("outcome") >= 0.5).cast("double")).alias("momentum"))


def rewards(snapshots: DataFrame) -> DataFrame:
    """One action for each snapshot (attempts, streak, mastery, achievement, frustrated, near_miss, autonomy, breakthrough, relatedness, days_since_reward), by the first rule that holds."""
    c = F.col
    throttled = F.coalesce(c("days_since_reward") < 2, F.lit(False))
    gated = lambda x: F.when(throttled, "cooldown").otherwise(x)
    milestone = (c("streak") >= 3) | (c("mastery") >= 0.85) | c("breakthrough")
    effort = clip(F.greatest(c("streak") / 3, c("attempts") / 5))
    blend = F.round(0.6 * effort + 0.4 * c("achievement"), 9)
    action = (
        F.when(c("attempts") < 1, "none").when(c("frustrated") | c("near_miss"), "encourage").when(c("autonomy") & milestone, gated("celebrate")).when(c("breakthrough") | (c("mastery") >= 0.85), gated("celebrate"))
        .when((blend >= 0.8) & (c("streak") >= 1), gated("celebrate")).when(c("relatedness") >= 0.75, "celebrate").when(c("achievement") < 0.2, "encourage").when((c("streak") >= 2) | (c("attempts") >= 2), "acknowledge").otherwise("none")
    )
    return snapshots.withColumn("action", action)


# Priorities of the kinds of messages, the least first.
PRIORITIES = {"break": 1, "reassure": 2, "encourage": 3, "praise": 4, "focus": 5, "scaffold": 6}


def guidance(events: DataFrame, n: int = 3) -> DataFrame:
    """Up to n messages for each learner's parents, by priority, from accuracy, last three affects, trend and attempts of each concept."""
    order = Window.partitionBy("learner_id", "concept_id")
    rows = events.select(
        "learner_id", "concept_id", "kind", "outcome", "difficulty", F.row_number().over(order.orderBy(F.desc("seq"))).alias("back"), "affect",
        F.when(answer() & F.col("outcome").isNotNull(), F.row_number().over(Window.partitionBy("learner_id", "concept_id", F.col("outcome").isNotNull()).orderBy("seq"))).alias("i"), F.count("outcome").over(order).alias("m"),
    )
    half = F.floor(F.col("m") / 2)
    state = rows.groupBy("learner_id", "concept_id").agg(
        F.count("*").alias("attempts"), (F.count_if(right()) / F.count("*")).alias("accuracy"), F.count_if((F.col("back") <= 3) & (F.col("affect") == "frustrated")).alias("frustrated"), F.max("difficulty").alias("difficulty"), F.max("m").alias("m"),
        F.avg(F.when(F.col("i") <= half, F.col("outcome"))).alias("head"), F.avg(F.when(F.col("i") > half, F.col("outcome"))).alias("tail"),
    )
    fr, acc, num = F.col("frustrated"), F.col("accuracy"), F.col("attempts")
    rising = (F.col("m") >= 4) & F.coalesce(F.col("tail") > F.col("head") + 0.05, F.lit(False))
    message = lambda priority, key: F.struct(F.lit(priority).alias("priority"), F.lit(key).alias("key"))
    calm = fr < 3
    found = F.array_compact(F.array(
        F.when(~calm, message(PRIORITIES["break"], "break_frustration")), F.when(calm & (fr >= 1) & ~rising, message(PRIORITIES["reassure"], "reassure_single_spike")), F.when(calm & rising & (fr >= 1) & (acc >= 0.3), message(PRIORITIES["encourage"], "encourage_rising")),
        F.when(calm & (acc >= 0.7) & (num >= 3) & (fr >= 1), message(PRIORITIES["praise"], "praise_effort")), F.when(calm & (acc >= 0.7) & (num >= 3) & (fr < 1) & (F.col("difficulty") / 5 >= 0.7), message(PRIORITIES["praise"], "praise_difficulty")), F.when(calm & (acc < 0.4) & (num >= 1) & (num <= 2), message(PRIORITIES["scaffold"], "scaffold_study_together")),
    ))
    listed = state.select("learner_id", "concept_id", F.explode(found).alias("x")).select("learner_id", "concept_id", "x.priority", "x.key")
    first = Window.partitionBy("learner_id").orderBy("priority", "concept_id", "key")
    return listed.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= n)
