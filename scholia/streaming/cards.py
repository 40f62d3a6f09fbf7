"""FSRS cards that follow a stream of learner events: keyed state of each learner, who has a card for each concept.

Concepts of a learner share a state, as each state costs a call in each batch. A card's state is the card over all events that can't change any more (those the watermark has passed) and a buffer of the
later ones in the order of (time, event). A late event goes to its place in the buffer, a repeated one is dropped there, and one that comes after
the watermark has passed it is dropped by Spark. Each change gives a row: the card over the folded events and the buffer, which is what
`memory.cards` gives for the events seen so far. A timer folds a buffer when the watermark passes it, and closes cards that have been idle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.operators.memory import DECAY, FACTOR, S_MAX, S_MIN, W
from scholia.sources.views import DAY_US

#: Cards of a learner's concepts, and the buffered events with the place of their concept.
STATE = (
    "concepts array<string>, d array<double>, s array<double>, reps array<long>, lapses array<long>, last_us array<long>, seen_us array<long>, nights array<long>, "
    "places array<long>, times array<long>, ids array<long>, kinds array<string>, outcomes array<double>"
)
CARD = "learner_id long, concept_id string, difficulty double, stability double, reps long, lapses long, last_review_us long, nights long, closed boolean"

#: d, s, reps, lapses, last_us, seen_us, nights
Card = tuple[float, float, int, int, int, int, int]
NEW: Card = (0.0, 0.0, 0, 0, 0, 0, 0)
#: t_us, event_id, kind, outcome
Event = tuple[int, int, str, float | None]


def _between(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def _first(g: int) -> tuple[float, float]:
    return _between(W[4] - math.exp((g - 1) * W[5]) + 1, 1.0, 10.0), max(S_MIN, W[g - 1])


def _again(d: float, s: float, g: int, days: float) -> tuple[float, float]:
    """Difficulty and stability after a later review."""
    lost = 1 - (1 + FACTOR * days / s) ** DECAY
    easy = _between(W[4] - math.exp(3 * W[5]) + 1, 1.0, 10.0)
    difficulty = _between(W[7] * easy + (1 - W[7]) * (d - W[6] * (g - 3) * (10 - d) / 9), 1.0, 10.0)
    if g == 1:
        lapse = W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(lost * W[14])
        return difficulty, min(max(lapse, S_MIN), s)
    growth = math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp(lost * W[10]) - 1) * (W[15] if g == 2 else 1.0)
    return difficulty, _between(s * (1 + growth), S_MIN, S_MAX)


def folded(card: Card, event: Event) -> Card:
    """The card after one more event, as in `memory.cards`."""
    d, s, reps, lapses, last, seen, nights = card
    t, _, kind, outcome = event
    answer, watch = kind == "answer" and outcome is not None, kind == "watch" and reps > 0
    if seen > 0 and 1 <= (t - seen) / DAY_US <= 2:
        nights += 1
    if answer or watch:
        g = 3 if watch or outcome >= 0.5 else 2 if outcome >= 0.3 else 1
        d, s = (round(x, 8) for x in (_again(d, s, g, max(0.0, (t - last) / DAY_US)) if reps else _first(g)))
        lapses += answer and reps > 0 and g == 1
        reps, last = reps + 1, t
        if watch:
            s *= 0.4
    return d, s, reps, int(lapses), last, t, nights


def _row(learner, concept: str | None, card: Card, closed: bool) -> tuple:
    d, s, reps, lapses, last, _, nights = card
    return learner, concept, d, s * min(1.04**nights, 1.3), reps, lapses, last if reps else None, nights, closed


def _updater(idle_days: float | None):
    names = [c.split()[0] for c in CARD.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cards: dict[str | None, Card] = {}
        buffers: dict[str | None, dict[tuple[int, int], Event]] = {}
        if state.exists:
            concepts, *fields, places, times, ids, kinds, outcomes = state.get
            cards = {c: tuple(f) for c, *f in zip(concepts, *fields, strict=True)}
            buffers = {c: {} for c in cards}
            for p, t, i, k, o in zip(places, times, ids, kinds, outcomes, strict=True):
                buffers[concepts[p]][t, i] = (t, i, k, o)
        changed = set()
        if not state.hasTimedOut:
            for rows in batches:
                for c, t, i, k, o in zip(*(rows[x].tolist() for x in ("concept_id", "t_us", "event_id", "kind", "outcome")), strict=True):
                    buffer = buffers.setdefault(c, {})
                    if (t, i) not in buffer:
                        buffer[t, i] = (t, i, k, None if o is None or math.isnan(o) else o)
                        changed.add(c)
        passed = state.getCurrentWatermarkMs() * 1000
        out, held, waiting, dues = [], {}, [], []
        for c, buffer in buffers.items():
            card, rest = cards.get(c, NEW), []
            for event in sorted(buffer.values(), key=lambda e: e[:2]):
                if event[0] <= passed:
                    card = folded(card, event)
                else:
                    rest.append(event)
            latest = card
            for event in rest:
                latest = folded(latest, event)
            ends = None if idle_days is None else latest[5] + int(idle_days * DAY_US)
            closed = not rest and ends is not None and ends <= passed
            if not closed:
                waiting += [(len(held), *event) for event in rest]
                held[c] = card
                dues += [rest[0][0] if rest else ends]  # fold when the watermark passes the first of the buffer, or close
            if c in changed or closed:
                out.append(_row(key[0], c, latest, closed))
        if held:
            state.update(([*held], *map(list, zip(*held.values(), strict=True)), *([list(x) for x in zip(*waiting, strict=True)] or [[], [], [], [], []])))
            if due := [x for x in dues if x is not None]:
                state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)  # numbers beside nulls stay whole

    return update


def replayed(events: DataFrame, lateness: str = "1 day", idle_days: float | None = None) -> DataFrame:
    """Cards of the learners' concepts that a batch has changed, for update mode: the columns of `memory.cards`, and closed.

    events: learner_id, concept_id, event_id, kind, outcome, ts, t_us; those without a time or an event are left out. An event up to `lateness` behind the
    latest one still finds its place, wherever it stands in the stream and however often it is repeated. The buffer of a key holds
    the events of that span. idle_days: the state of a key goes when the watermark is so much past its last event; its last row then has closed
    true, and an event after that begins a new card. None: a card's state stays as long as the log runs.
    """
    columns = ["learner_id", "concept_id", "event_id", F.coalesce("kind", F.lit("")).alias("kind"), "outcome", "ts", "t_us"]
    known = events.where("ts IS NOT NULL AND t_us IS NOT NULL AND event_id IS NOT NULL").select(columns).withWatermark("ts", lateness)
    return known.groupBy("learner_id").applyInPandasWithState(_updater(idle_days), CARD, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def arrivals(spark: SparkSession, events: DataFrame, path: str, days: int = 8, jitter_hours: int = 12) -> None:
    """Writes events as they would arrive: every one up to `jitter_hours` late, one in seven twice, files of `days` days after each other.

    A stream reads files in the order of their times, so the files of each span are written by a job of its own.
    """
    late = F.pmod(F.xxhash64("event_id"), F.lit(jitter_hours * 3600)) * 1_000_000
    again = F.array_repeat(F.lit(1), F.when(F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(7)) == 0, 2).otherwise(1))
    arriving = events.where("t_us IS NOT NULL").select("learner_id", "concept_id", "event_id", "kind", "outcome", "ts", "t_us", F.explode(again).alias("one"))
    spanned = arriving.withColumn("span", F.floor((F.col("t_us") + late) / (days * DAY_US))).drop("one")
    for span in sorted(r.span for r in spanned.select("span").distinct().toLocalIterator()):  # few: the log's time over `days`
        spanned.where(F.col("span") == span).drop("span").write.mode("append").parquet(path)
