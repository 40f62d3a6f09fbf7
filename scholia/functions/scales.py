"""Scales, word lists and weights that results depend on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Valence and arousal of affect tags, defaults of untagged events.
VALENCE = {"excited": 1.0, "confident": 0.95, "engaged": 0.9, "happy": 0.85, "curious": 0.8, "neutral": 0.6, "bored": 0.45, "surprised": 0.4, "tired": 0.3, "frustrated": 0.25, "anxious": 0.2, "stressed": 0.2, "angry": 0.15}
AROUSAL = {"excited": 0.9, "angry": 0.9, "happy": 0.7, "engaged": 0.7, "curious": 0.7, "confident": 0.6, "surprised": 0.5, "neutral": 0.5, "bored": 0.35, "tired": 0.25, "stressed": 0.85, "anxious": 0.85}
DEFAULT_VALENCE, DEFAULT_AROUSAL, POSITIVE = 0.6, 0.5, 0.55
# How fast attention wears off by affect.
HAZARD = {"tired": 1.5, "frustrated": 1.8, "bored": 1.4, "anxious": 1.2, "neutral": 1.0, "engaged": 0.8, "happy": 0.7}
# Bloom levels in order; those of application and above.
BLOOM = ("remember", "understand", "apply", "analyze", "evaluate", "create")
APPLICATION = BLOOM[2:]
# RIASEC dimensions and weights by subject; other subjects are uniform.
RIASEC = ("Realistic", "Investigative", "Artistic", "Social", "Enterprising", "Conventional")
SUBJECT_RIASEC = {
    "math": {"Investigative": 0.5, "Conventional": 0.3, "Realistic": 0.2},
    "science": {"Investigative": 0.6, "Realistic": 0.4},
    "physics": {"Investigative": 0.6, "Realistic": 0.4},
    "cs": {"Investigative": 0.6, "Realistic": 0.3, "Conventional": 0.1},
    "language": {"Social": 0.4, "Artistic": 0.3, "Conventional": 0.3},
    "arts": {"Artistic": 0.7, "Social": 0.3},
    "music": {"Artistic": 0.7, "Social": 0.3},
    "social_science": {"Social": 0.5, "Enterprising": 0.3, "Investigative": 0.2},
    "commerce": {"Enterprising": 0.5, "Conventional": 0.3, "Social": 0.2},
}
# FSRS-6 default weights.
FSRS_WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)


def looked_up(key: Column, table: dict[str, float], default: float) -> Column:
    """The key's value in a small fixed table, as a literal map."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))

#: Rows of a table that is laid beside every learner, as a curriculum is.
MOST_FEW = 100_000


def few(rows: DataFrame) -> DataFrame:
    """The rows, if they are MOST_FEW at most; an error otherwise."""
    if rows.limit(MOST_FEW + 1).count() > MOST_FEW:
        raise ValueError(f"a table of more than {MOST_FEW} rows can't be laid beside every learner")
    return rows
