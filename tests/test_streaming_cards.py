import datetime
import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import memory
from scholia.streaming import cards, replay

DAY = 86_400_000_000
SCHEMA = "learner_id long, concept_id string, event_id long, kind string, outcome double, t_us long"
STREAM = "learner_id long, concept_id string, event_id long, kind string, outcome double, ts timestamp, t_us long"
COLUMNS = ("difficulty", "stability", "reps", "lapses", "last_review_us", "nights")


def made(seed, n=400, days=40):
    rng = random.Random(seed)
    start = 19_700 * DAY
    return [(rng.randint(1, 4), rng.choice(["c1", "c2", None]), i, rng.choice(["answer", "answer", "watch", "affect", None]), rng.choice([None, 0.1, 0.35, 0.6, 1.0]), start + rng.randint(0, days * DAY)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t_us"))


def batch(spark, rows):
    ordered = frame(spark, rows).withColumn("seq", F.col("event_id")).fillna("", ["kind"])
    return {(r.learner_id, r.concept_id): tuple(r[c] for c in COLUMNS) for r in memory.cards(ordered).collect()}


def arrive(spark, path, batches):
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, lateness, **options):
    events = replay.read(spark, f"{tmp}/in", STREAM, 1)
    replay.to_table(cards.replayed(events, lateness, **options), f"{tmp}/out", f"{tmp}/checkpoint").awaitTermination()
    return {(r.learner_id, r.concept_id): r for r in replay.current(spark, f"{tmp}/out", ["learner_id", "concept_id"]).collect()}


def same(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        assert tuple(got[key][c] for c in COLUMNS) == pytest.approx(row, rel=1e-7), key


def late(rows, seed, days):
    """Batches in the order of arrival: up to `days` late, one in four repeated, also in a later batch."""
    rng = random.Random(seed)
    arriving = sorted([(r[5] + rng.random() * days * DAY, r) for r in rows] + [(r[5] + rng.random() * days * DAY, r) for r in rows[::4]], key=lambda x: x[0])
    told = [r for _, r in arriving]
    return [told[i : i + 60] for i in range(0, len(told), 60)]


def test_late_and_repeated_events_end_in_the_batch_cards(spark, tmp_path):
    rows = made(1)
    arrive(spark, f"{tmp_path}/in", late(rows, 2, 3))
    same(run(spark, tmp_path, "3 days"), batch(spark, rows))


def test_restart_from_the_checkpoint(spark, tmp_path):
    rows = made(3)
    batches = late(rows, 4, 2)
    arrive(spark, f"{tmp_path}/in", batches[:4])
    run(spark, tmp_path, "2 days")
    arrive(spark, f"{tmp_path}/in", batches[4:])
    same(run(spark, tmp_path, "2 days"), batch(spark, rows))


def test_events_behind_the_watermark_are_left_out(spark, tmp_path):
    start = 19_700 * DAY
    rows = [(1, "c1", 1, "answer", 1.0, start), (1, "c1", 2, "answer", 1.0, start + 20 * DAY), (2, "c1", 3, "answer", 0.0, start + 30 * DAY)]
    arrive(spark, f"{tmp_path}/in", [rows[:1], rows[1:2], rows[2:], [(1, "c1", 4, "answer", 0.0, start + DAY)]])
    same(run(spark, tmp_path, "1 day"), batch(spark, rows))


def test_idle_state_goes_by_timer(spark, tmp_path):
    start = 19_700 * DAY
    rows = [(1, "c1", 1, "answer", 1.0, start), (1, "c1", 2, "answer", 1.0, start + 2 * DAY)]
    others = [(2, "c2", 10 + i, "answer", 1.0, start + (5 + 10 * i) * DAY) for i in range(5)]
    arrive(spark, f"{tmp_path}/in", [rows, *[[x] for x in others]])
    got = run(spark, tmp_path, "1 day", idle_days=15)
    assert got[1, "c1"].closed and not got[2, "c2"].closed
    same(got, batch(spark, rows + others))
    # the key begins anew afterwards
    again = [(1, "c1", 99, "answer", 0.0, start + 50 * DAY)]
    arrive(spark, f"{tmp_path}/in", [again])
    after = run(spark, tmp_path, "1 day", idle_days=15)
    assert tuple(after[1, "c1"][c] for c in COLUMNS) == pytest.approx(batch(spark, again)[1, "c1"], rel=1e-7)


def test_rows_without_time_or_event_and_no_rows(spark, tmp_path):
    rows = [(1, "c1", None, "answer", 1.0, 19_700 * DAY), (1, "c1", 5, "answer", 1.0, None), (3, "c1", 6, "affect", None, 19_700 * DAY)]
    arrive(spark, f"{tmp_path}/in", [rows])
    got = run(spark, tmp_path, "1 day")
    assert set(got) == {(3, "c1")} and got[3, "c1"].reps == 0 and got[3, "c1"].last_review_us is None
