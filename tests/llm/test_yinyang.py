import hashlib
import math
import random

import pytest

from scholia.llm import yinyang


def brute(rows, dim, k, rounds):
    """{(position of the row): (cluster, distance)}, centroids: full scans in whole numbers."""
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        new = []
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(vectors, of, strict=True) if o == c]
            new.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else centroids[c])
        centroids = new
    return sorted(((i, near(v)[1], min(near(v)[0], (1 << 63) - 1)) for i, v in vectors), key=repr), centroids


def check(spark, rows, dim, k, rounds, groups=None, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, id string, cluster int, kind int").repartition(3)
    found, centroids = yinyang.clustered(df, "embedding", "vec_id", dim=dim, k=k, rounds=rounds, groups=groups)
    want, means = brute([r[:2] for r in rows], dim, k, rounds)
    assert centroids == means
    assert sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=repr) == want
    return found, centroids


def made(rng, n, dim, spread=1.0):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [[x + rng.gauss(0, spread) for x in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_full_scans(spark, seed):
    rng = random.Random(seed)
    rows = [(i, v, "x", 1, 1) for i, v in enumerate(made(rng, 400, 8, 0.3 * seed))]
    found, centroids = check(spark, rows, 8, 20, 6, groups=4)
    table = yinyang.report(found, centroids).collect()
    assert len(table) == 400 and all(r.inertia == sum(x.distance for x in table) for r in table)
    own = {}
    for r in table:
        own[r.cluster] = own.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == own[r.cluster] for r in table)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in table)


def test_ties_and_copies(spark):
    rng = random.Random(3)
    grid = [[rng.randint(-2, 2) / 4 for _ in range(3)] for _ in range(300)]  # many equal distances
    rows = [(i // 2, v, None, None, None) for i, v in enumerate(grid)] + [(None, [0.25, 0.25, 0.25], "x", 1, 1)] * 4
    check(spark, rows, 3, 12, 4, groups=3)


def test_odd_rows(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, "x", 1, 1) for i, v in enumerate(made(rng, 40, 4))]
    rows += [(50, None, "x", 1, 1), (51, [], "x", 1, 1), (52, [1.0] * 3, "x", 1, 1), (53, [1.0, None, 1.0, 1.0], "x", 1, 1), (54, [nan] * 4, "x", 1, 1), (55, [inf] * 4, "x", 1, 1), (56, [1.0, 2.0, -inf, 0.0], "x", 1, 1)]
    check(spark, rows, 4, 7, 3)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, v, "x", 1, 1) for i, v in enumerate(made(rng, 60, 4))]
    rows += [(100 + i, [1e30 * rng.random(), 1.0, -1e12, 3e9 + i], "x", 1, 1) for i in range(12)]
    rows += [(200 + i, [3e5 + i, 1e4, 17000.0 + i, -5e5], "x", 1, 1) for i in range(12)]
    check(spark, rows, 4, 15, 4, groups=3)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(i, [float(i), 0.5], "x", 1, 1) for i in range(3)], 2, 10, 2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centroids = yinyang.clustered(empty, "embedding", "vec_id")
    assert found.count() == 0 and centroids == [] and yinyang.report(found, centroids).count() == 0


def test_filters_pass_over_most(monkeypatch):
    """Once centroids settle, few distances are computed."""
    import numpy as np

    rng = np.random.default_rng(6)
    middles = rng.normal(0, 4, (20, 16))
    x = np.floor(256 * (middles[rng.integers(0, 20, 2000)] + rng.normal(0, 0.2, (2000, 16))))
    start = [[int(v) for v in np.floor(256 * m)] for m in middles]
    groups = yinyang._grouped(start, 4)
    step = yinyang.Step(start, groups, [0.0] * 20, 256, False)
    a = yinyang._Assigner(step)
    cluster, upper, lower = np.full(2000, -1), np.full(2000, np.inf), np.full((2000, len(groups)), -np.inf)
    a.assign(x, cluster, upper, lower)
    nudged = [[v + 3 for v in c] for c in start]
    drift = [math.sqrt(9 * 16)] * 20
    b = yinyang._Assigner(yinyang.Step(nudged, groups, drift, 256, False))
    rows = []
    monkeypatch.setattr(b, "squared", lambda part, of, f=b.squared: rows.append(len(part) * len(of)) or f(part, of))
    b.assign(x, cluster, upper, lower)
    assert sum(rows) < 0.2 * 2000 * 20
