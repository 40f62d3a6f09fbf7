import random
import uuid

import pytest
from pyspark.sql import functions as F

from scholia.operators import memory
from scholia.sources.store import Log, Store

SCHEMA = "id long, kind string, at long, text string"


def rows(df):
    return sorted(((r.id, r.kind, r.at, r.text, r.version) for r in df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, str(tmp_path), ["id", "kind"], 8)
    want = {}
    for step in range(4):
        batch = [(rng.choice([None, *range(30)]), rng.choice(["a", "b", None]), rng.randint(0, 50), f"{step}.{i}") for i in range(25)]
        store.merge(frame(spark, batch), ["at"])
        new = {}
        for r in batch:
            new.setdefault(r[:2], []).append(r)
        for key, own in new.items():
            old, n = want.get(key, (None, 0))
            best = max(own, key=lambda r: r[2])
            # of equal times a change goes before what is stored; between changes it is any of them
            want[key] = ([old] if old and old[2] > best[2] else [r for r in own if r[2] == best[2]]), n + len(own)
        got = {r[:2]: (r[:4], r[4]) for r in rows(store.read())}
        assert set(got) == set(want)
        for key, (options, n) in want.items():
            assert got[key][0] in (options if isinstance(options, list) else [options]) and got[key][1] == n
            want[key] = (got[key][0], n)
    assert rows(Store(spark, str(tmp_path), ["other"]).read()) == rows(store.read())


def test_a_merge_of_one_key_leaves_other_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["id"], 16)
    store.merge(frame(spark, [(i, "a", 1, "x") for i in range(300)]))
    before = set(store.read().inputFiles())
    store.merge(frame(spark, [(7, "b", 2, "y")]))
    after = set(store.read().inputFiles())
    assert len(before) == len(after) == 16 and len(before - after) == 1
    assert len(store.lookup(frame(spark, [(7, None, None, None)])).inputFiles()) == 1
    assert [r.kind for r in store.lookup(frame(spark, [(7, None, None, None)])).collect()] == ["b"]
    # the old version is still there, until it is swept
    assert [r.kind for r in store.read(version=1).where("id = 7").collect()] == ["a"]
    store.vacuum(1)
    assert store.read().count() == 300
    with pytest.raises(Exception):
        store.read(version=1).collect()


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["id"], 4)
    store.merge(frame(spark, [(i, "a", 1, "x") for i in range(20)]))
    want = rows(store.read())
    broken = frame(spark, [(i, "b", 2, "y") for i in range(20)]).withColumn("text", F.when(F.col("id") == 13, F.raise_error("lost")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken)
    assert rows(store.read()) == want and rows(Store(spark, str(tmp_path), ["id"]).read()) == want
    store.merge(frame(spark, [(13, "c", 3, "z")]))
    assert [r.kind for r in store.read().where("id = 13").collect()] == ["c"]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    first = Store(spark, str(tmp_path), ["id"], 4)
    first.merge(frame(spark, [(1, "a", 1, "x")]))
    second = Store(spark, str(tmp_path), ["id"])
    first.merge(frame(spark, [(2, "a", 1, "x")]))
    want = rows(first.read())
    with pytest.raises(Exception):
        second.merge(frame(spark, [(3, "a", 1, "x")]))
    assert rows(Store(spark, str(tmp_path), ["id"]).read()) == want


def test_updates_and_removals(spark, tmp_path):
    store = Store(spark, str(tmp_path), ["id"], 8)
    with pytest.raises(ValueError):
        store.read()
    store.merge(frame(spark, [(i, "a" if i % 2 else None, i, "x") for i in range(40)]))
    files = set(store.read().inputFiles())
    store.update(F.col("at") == 5, {"text": F.lit("new")})
    assert len(files - set(store.read().inputFiles())) == 1
    assert [(r.text, r.version) for r in store.read().where("id = 5").collect()] == [("new", 2)]
    store.update(F.col("kind") == "none", {"text": F.lit("never")})
    store.remove(frame(spark, [(i, None, None, None) for i in (*range(10, 40), 99)]))
    assert {r.id for r in store.read().collect()} == set(range(10))
    store.remove(store.read().select("id"))
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.update(F.col("at") == 5, {"id": F.lit(1)})
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame([(1, 2)], "id long, other long"))


def test_replay_of_the_log_has_no_exchange(spark, tmp_path):
    log = Log(spark, f"log_{uuid.uuid4().hex}", str(tmp_path / "log"), buckets=4)
    events = spark.createDataFrame([(i % 5, f"c{i % 3}", i, "answer", (i % 10) / 10, 19_700 * 86_400_000_000 + i * 10**10) for i in range(120)], "learner_id long, concept_id string, event_id long, kind string, outcome double, t_us long")
    log.append(events.where("event_id < 70"), ["t_us", "event_id"])
    log.append(events.where("event_id >= 70"), ["t_us", "event_id"])
    assert sorted((r.learner_id, r.seq) for r in log.read().collect()) == [(i, n) for i in range(5) for n in range(1, 25)]
    replayed = memory.cards(log.read())
    assert "Exchange" not in replayed._jdf.queryExecution().executedPlan().toString()
    want = memory.cards(events.withColumn("seq", F.col("event_id")))
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, want.collect()))
    spark.sql(f"DROP TABLE {log.table}")
