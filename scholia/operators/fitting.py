"""Fits of memory models: three weights for each learner, for all learners at once.

A learner's histories are chains of answers on a concept. The predicted recall of an answer is e^(-days/S), where S begins as
initial_stability + difficulty_sens * difficulty and is multiplied or divided by stability_gain by each answer. The weights of least loss (root mean
square error and a small penalty on the way from the defaults) are sought from the best point of a grid by coordinate descent.

The learners of a task go through its rounds together: a round tries every move of every learner that is still moving in one pass over
their chains, position by position, with an array of chains by moves. So no history is copied for a point, and a round costs the same numpy calls
for one learner as for thousands.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.sources.views import DAY_US

DEFAULTS = (1.0, 0.5, 1.5)
BOUNDS = ((0.0, 1000.0), (0.0, 30.0), (1.0, 6.0))
# The grid that the descent begins from, and its first steps.
BASES = (0.05, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 100.0, 300.0)
SENSES = (0.0, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0)
GAINS = (1.0, 1.2, 1.5, 2.0, 3.0, 4.0, 6.0)
STEPS = (1.5, 1.5, 0.25)
TOLERANCE, STRICT = 1e-6, 1e-12
#: Events of the learners that go through the rounds together; a learner with more goes alone.
EVENTS = 100_000
FIT = "learner_id {}, initial_stability double, difficulty_sens double, stability_gain double, n_reviews long, n_observed long, loss_before double, loss_after double, converged boolean, iterations int"


class _Chains:
    """Chains of some learners, the longest first, by position."""

    def __init__(self, owner: np.ndarray, first: np.ndarray, days: list[np.ndarray], right: list[np.ndarray], outcome: list[np.ndarray]) -> None:
        order = np.argsort([-len(d) for d in days], kind="stable")
        self.owner, self.first = owner[order], first[order]
        size = np.array([len(days[i]) for i in order])
        n = int(size.max(initial=0))
        self.width = [int((size > t).sum()) for t in range(n)]  # chains that reach so far
        self.days, self.right, self.outcome = ([np.array([x[i][t] for i in order[:w]]) for t, w in enumerate(self.width)] for x in (days, right, outcome))

    def of(self, learners: np.ndarray, n: int) -> _Chains:
        """Chains of some learners, which get the numbers of their places."""
        place = np.full(n, -1)
        place[learners] = np.arange(len(learners))
        out = _Chains.__new__(_Chains)
        keep = place[self.owner] >= 0
        out.owner, out.first = place[self.owner[keep]], self.first[keep]
        kept = [keep[:w] for w in self.width]
        out.width = [int(k.sum()) for k in kept]
        out.days, out.right, out.outcome = ([x[k] for x, k in zip(held, kept, strict=True)] for held in (self.days, self.right, self.outcome))
        return out

    def losses(self, points: np.ndarray, counts: np.ndarray, weight: float) -> np.ndarray:
        """Loss of each learner (rows) at each of its points (learners x points x 3)."""
        base, sense, gain = (points[self.owner, :, k] for k in range(3))
        s = base + sense * self.first[:, None]
        errors = np.zeros(points.shape[:2])
        for t, w in enumerate(self.width):
            s, g = s[:w], gain[:w]
            if t:
                error = np.exp(-self.days[t][:, None] / np.maximum(s, 1e-9)) - self.outcome[t][:, None]
                np.add.at(errors, self.owner[:w], error * error)
                s = np.clip(np.where(self.right[t][:, None], s * g, s / g), *BOUNDS[0])
        penalty = weight * ((points - np.array(DEFAULTS)) ** 2).sum(2)
        return np.sqrt(errors / np.maximum(counts, 1)[:, None]) + penalty


def _moves(best: np.ndarray, step: np.ndarray, visit: list[int]) -> np.ndarray:
    """The points a round tries, in its order: coordinates as visited, then long to short moves, then up and down."""
    out = []
    for c, far, sign in itertools.product(visit, (4.0, 2.0, 1.0), (1.0, -1.0)):
        trial = best.copy()
        trial[:, c] = np.clip(trial[:, c] + sign * far * step[:, c], *BOUNDS[c])
        out.append(trial)
    return np.stack(out, axis=1)


def _fitted(chains: _Chains, counts: np.ndarray, weight: float, rounds: int, seed: int) -> pd.DataFrame:
    n = len(counts)
    default = np.tile(np.array(DEFAULTS), (n, 1))
    before = chains.losses(default[:, None, :], counts, weight)[:, 0]
    best, loss = default.copy(), before.copy()
    for base in BASES:  # the grid, a tenth at a time
        points = np.array([(base, s, g) for s in SENSES for g in GAINS])
        found = chains.losses(np.broadcast_to(points, (n, *points.shape)), counts, weight)
        # in the order of the points, each strictly better one is taken: with room for STRICT that is the first of least loss but for rounding
        for k in range(len(points)):
            better = found[:, k] < loss - STRICT
            best[better], loss[better] = points[k], found[better, k]
    step = np.tile(np.array(STEPS), (n, 1))
    taken, converged = np.zeros(n, np.int64), np.zeros(n, bool)
    order = random.Random(seed)
    active = np.flatnonzero(counts > 0)
    current = chains.of(active, n)
    for _ in range(rounds):
        if len(active) == 0:
            break
        visit = [0, 1, 2]
        order.shuffle(visit)
        points = _moves(best[active], step[active], visit)
        found = current.losses(points, counts[active], weight)
        better = found < loss[active, None] - STRICT
        moved, first = better.any(1), better.argmax(1)
        rows = np.flatnonzero(moved)
        best[active[rows]], loss[active[rows]] = points[rows, first[rows]], found[rows, first[rows]]
        step[active[~moved]] *= 0.5
        taken[active] += 1
        done = ~moved & (step[active].max(1) < TOLERANCE)
        if done.any():
            converged[active[done]] = True
            active = active[~done]
            current = chains.of(active, n)
    seen = counts > 0
    best[~seen], before, loss = default[~seen], np.where(seen, before, 0.0), np.where(seen, loss, 0.0)
    return pd.DataFrame(
        {"initial_stability": best[:, 0], "difficulty_sens": best[:, 1], "stability_gain": best[:, 2], "n_observed": counts, "loss_before": before, "loss_after": loss, "converged": converged, "iterations": taken.astype(np.int32)}
    )


def _worker(weight: float, rounds: int, seed: int):
    def fit(held: list) -> pd.DataFrame:
        owner, first, days, right, outcome, counts, reviews = [], [], [], [], [], [], []
        for i, (_, chains) in enumerate(held):
            counts.append(sum(len(c["days"]) - 1 for c in chains))
            reviews.append(sum(len(c["days"]) for c in chains))
            for c in chains:
                owner.append(i)
                first.append(c["first"])
                days.append(np.asarray(c["days"], np.float64))
                outcome.append(np.asarray(c["outcomes"], np.float64))
                right.append(outcome[-1] >= 0.5)
        out = _fitted(_Chains(np.array(owner, np.int64), np.array(first), days, right, outcome), np.array(counts, np.int64), weight, rounds, seed)
        out.insert(0, "learner_id", [k for k, _ in held])
        out.insert(4, "n_reviews", reviews)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for rows in batches:
            for learner, chains in zip(rows["learner_id"], rows["chains"], strict=True):
                held.append((learner, chains))
                size += sum(len(c["days"]) for c in chains)
                if size >= EVENTS:
                    yield fit(held)
                    held, size = [], 0
        if held:
            yield fit(held)

    return run


def fit(events: DataFrame, *, penalty: float = 1e-4, rounds: int = 500, seed: int = 0) -> DataFrame:
    """The three weights of every learner with an answer, and the losses at the defaults and at them.

    events: learner_id, concept_id, kind, outcome, difficulty (1 to 5, null: the middle), t_us, seq. An answer's days are those since the answer before
    it on the concept; the first one of a chain is no observation, and a learner without observations has the defaults, losses of 0 and no rounds. loss_after is never above
    loss_before. converged: all steps fell below the tolerance within `rounds` joint rounds. One learner's answers have to fit in a task.
    """
    kind = events.schema["learner_id"].dataType.simpleString()
    answers = events.where("kind = 'answer' AND outcome IS NOT NULL").select("learner_id", "concept_id", F.struct("t_us", "seq", F.col("outcome").cast("double").alias("outcome"), F.col("difficulty").cast("double").alias("difficulty")).alias("x"))
    chains = answers.groupBy("learner_id", "concept_id").agg(F.array_sort(F.collect_list("x")).alias("h"))
    difficulty = F.get("h", F.lit(0))["difficulty"]
    eased = F.when(difficulty.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (difficulty - 1) / 4)))
    days = F.transform("h", lambda x, i: F.when(i == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (x["t_us"] - F.get("h", i - 1)["t_us"]) / DAY_US)))
    chain = F.struct(eased.alias("first"), days.alias("days"), F.col("h.outcome").alias("outcomes"))
    learners = chains.groupBy("learner_id").agg(F.collect_list(chain).alias("chains"))
    return learners.mapInPandas(_worker(penalty, rounds, seed), FIT.format(kind))
