"""Concept profiles and the layer of learning outcomes: Bloom levels from the verbs of a concept's texts, outcomes, and what they inherit from the concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import curriculum

# What an outcome says at each Bloom level.
STATEMENTS = {
    "remember": "recall and describe the concept of %s",
    "understand": "explain and compare the concept of %s",
    "apply": "apply the concept of %s to solve problems",
    "analyze": "analyze problems and situations involving %s",
    "evaluate": "evaluate and justify decisions involving %s",
    "create": "design and create solutions involving %s",
}
# Words of documents about schools that are no concepts.
JUNK = (
    "board", "council", "candidate", "candidates", "textbook", "textbooks", "reprint", "reprints", "examination", "examinations", "students", "student", "school", "schools", "book", "books", "curiosity", "people", "persons", "person",
    "activity", "activities", "figure", "figures", "question", "questions", "answers", "answer", "chapter", "chapters", "exercise", "exercises", "section", "sections", "page", "pages", "notice", "notices", "notification", "notifications",
    "circular", "circulars", "byelaw", "byelaws", "scheme", "schemes", "certificate", "certificates", "application", "applications", "college", "colleges", "university", "universities", "committee", "committees", "subject", "subjects",
    "teacher", "teachers", "class", "classes", "grade", "grades", "lesson", "lessons", "unit", "units",
)
# Labels that may be concepts but are nobody's prerequisite.
NO_PREREQUISITE = (
    "each", "every", "any", "all", "some", "other", "others", "various", "different", "many", "several", "things", "thing", "use", "uses", "used", "arrangement", "basis", "common", "certain", "particular", "people", "persons", "person",
    "one", "two", "new", "important", "following", "first", "next", "now", "like", "include", "etc", "place", "places", "part", "parts", "types", "type", "kind", "kinds", "ways", "way", "time", "times", "day", "days", "make", "made",
    "show", "shows", "find", "found", "know", "called", "said", "say", "see", "look", "give", "take", "come", "go", "work", "works", "same", "more", "most", "much", "small", "big", "long", "short", "good", "great", "own", "together",
    "around", "about", "into", "with", "without", "example", "examples", "world", "nature", "life", "question", "answer", "test", "learning", "education", "environment", "community", "culture", "skills", "skill", "ward", "wards", "boxes",
    "no", "not", "yes", "land", "poem", "poems", "mother", "writing", "size", "given number", "10 equal", "each case", "exploratory problems", "presence", "ab", "special thanks", "experiment", "experiments",
    "transformative learning culture", "national education policy 2020", "ganita prakash", "poorvi", "curiosity", "science", "mathematics", "english", "hindi", "world around us", "creative and critical thinking",
)


def _plain(label: str) -> Column:
    return F.lower(F.trim(F.col(label)))


def concepts(found: DataFrame) -> DataFrame:
    """Occurrences (label and other columns) of labels that are concepts: no junk, and with a clean label."""
    return found.where(~_plain("label").isin(*JUNK) & X.clean_label(F.col("label")))


def prerequisites(voted: DataFrame) -> DataFrame:
    """Votes (prerequisite, concept, ...) without those for labels that carry nothing."""
    return voted.where(~_plain("prerequisite").isin(*NO_PREREQUISITE) & ~_plain("prerequisite").isin(*JUNK))


def bloom(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """label, bloom: the level of most verbs in the texts of a label's chunks (ties: the higher level; no verb: understand).

    A chunk's verbs are counted by level once, in its row; only these six numbers meet the labels.
    """
    seen: set[str] = set()
    counts = []
    for level, verbs in curriculum.BLOOM_VERBS.items():
        own = [v for v in verbs if v not in seen]
        seen |= set(own)
        counts.append(F.size(F.filter("t", curriculum._one_of(own))).alias(level))
    told = chunks.select("id", X.tokens(F.col("text")).alias("t")).select("id", *counts)
    levels = list(curriculum.BLOOM_VERBS)
    summed = found.select("label", "id").distinct().join(told, "id").groupBy("label").agg(*(F.sum(c).alias(c) for c in levels))
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("level")) for i, c in enumerate(levels))))
    return summed.select("label", F.when(best["n"] > 0, best["level"]).otherwise("understand").alias("bloom"))


def profiles(found: DataFrame, chunks: DataFrame, voted: DataFrame) -> DataFrame:
    """label, chunks, documents, prerequisites, bloom, difficulty, hours, outcome_id, statement of each label that occurs."""
    by = found.groupBy("label").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))
    n = voted.groupBy(F.col("concept").alias("label")).agg(F.count("*").alias("prerequisites"))
    joined = by.join(n, "label", "left").fillna(0, ["prerequisites"]).join(bloom(found, chunks), "label")
    difficulty = curriculum.difficulty_of(F.col("bloom"), F.col("chunks"), F.col("documents"), F.col("prerequisites"))
    said = F.lit(None).cast("string")
    for level, statement in STATEMENTS.items():
        said = F.when(F.col("bloom") == level, F.format_string(statement, "label")).otherwise(said)
    out = joined.withColumn("difficulty", difficulty)
    return out.withColumns({"hours": 0.5 * F.col("difficulty") + 0.5, "outcome_id": F.concat(F.lit("lo:"), F.substring(F.sha1(F.concat("bloom", F.lit(":"), "label")), 1, 16)), "statement": said})


def top_by_subject(profiled: DataFrame, subjects: DataFrame, n: int) -> DataFrame:
    """The n labels of each subject with most chunks there: subject, rank, label, chunks, bloom. subjects: label, subject, chunks."""
    order = Window.partitionBy("subject").orderBy(F.desc("chunks"), "label")
    return subjects.join(profiled.select("label", "bloom"), "label").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("subject", "rank", "label", "chunks", "bloom")


def layer(profiled: DataFrame, voted: DataFrame) -> DataFrame:
    """type, source, target, weight: each concept maps to its outcome, and outcomes inherit the prerequisites of their concepts with the votes' scores."""
    maps = profiled.select(F.lit("MAPS_TO").alias("type"), F.col("label").alias("source"), F.col("outcome_id").alias("target"), F.lit(1.0).alias("weight"))
    ids = profiled.select("label", "outcome_id")
    joined = voted.join(ids.withColumnsRenamed({"label": "prerequisite", "outcome_id": "source"}), "prerequisite").join(ids.withColumnsRenamed({"label": "concept", "outcome_id": "target"}), "concept")
    inherited = joined.select(F.lit("PREREQUISITE_OF").alias("type"), "source", "target", F.least(F.lit(1.0), F.round("score", 4)).alias("weight"))
    return maps.unionByName(inherited)
