"""Near pairs against all pairs, and what is carried to find them."""

import random

from scholia.operators import assessment
from scholia.sources import shared


def _sets(rng, n):
    words = [f"w{i}x" for i in range(400)]
    out = []
    while len(out) < n:
        base = rng.sample(words, rng.choice((4, 9, 30, 80)))
        for _ in range(rng.choice((1, 1, 6))):
            own = [w for w in base if rng.random() > 0.08] + rng.sample(words, rng.randrange(3))
            out.append(own)
    return out[:n]


def test_near_pairs_are_those_of_all_pairs_in_cells_of_any_size(spark, monkeypatch):
    texts = _sets(random.Random(5), 150)
    sets = {}
    for i, ws in enumerate(texts):
        if len(set(ws)) >= 4:
            sets.setdefault(frozenset(ws), i)
    least = {i: s for s, i in sets.items()}
    of = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j): of(a, b) for i, a in least.items() for j, b in least.items() if i < j and of(a, b) >= 0.75}
    assert len(want) > 40
    rows = spark.createDataFrame([*((i, " ".join(ws)) for i, ws in enumerate(texts)), (900, None), (901, "")], "id long, text string").repartition(3)
    for cell in (2, 4096):
        monkeypatch.setattr(assessment, "CELL", cell)
        assert {(r.a, r.b): r.similarity for r in assessment.near_pairs(rows, "text", "id").collect()} == want
    assert assessment.near_pairs(rows.where("id >= 900"), "text", "id").count() == 0


def test_only_pairs_that_may_be_near_get_their_whole_sets(spark, monkeypatch):
    kept = []
    written = shared.written
    monkeypatch.setattr(shared, "written", lambda df: kept.append(written(df)) or kept[-1])
    # all share a rare word, which makes them candidates, and little else
    rows = spark.createDataFrame([(i, "shared " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(30)], "id long, text string")
    assert assessment.near_pairs(rows, "text", "id").count() == 0
    assert [df.count() for df in kept if df.columns[:2] == ["x", "y"]] == [0]
