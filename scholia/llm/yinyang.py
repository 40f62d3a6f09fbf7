"""Exact k-means over integer vectors with Yinyang's bounds.

The centroids are put into groups once. Every vector keeps its centroid, an upper bound of the distance to it and a lower
bound for each group. After the centroids have moved, bounds move by at most as much: a vector whose least lower bound
is above its upper bound stays where it is (the global filter); otherwise the bound of each group decides whether the group's
centroids are scanned (the group filter), and those are compared exactly. Bounds leave room for rounding, and a centroid is
passed over only if it is strictly further away, so ties and results are those of a full scan.

A round is one pass over the vectors, which writes them with their bounds and each task's changes of the sums of its
clusters: only vectors that have moved change a sum. Centroids (k rows) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm._spark import shared_dir

#: Components up to this size give exact distances in floating point for up to 64 of them; larger ones are compared as whole numbers.
NARROW = 1 << 22
#: Room for rounding in bounds, relative and absolute.
SLACK, LEAST = 1e-9, 1e-6
#: Bits of a limb: sums are added up as longs, limb by limb.
LIMB = 31
LONG = (1 << 63) - 1
#: Rows that are worked on at once.
RUN = 4096

Vector = list[int]


class Step(NamedTuple):
    """What a round's tasks get."""

    centroids: list[Vector]
    groups: list[list[int]]
    drift: list[float]  # of each centroid since the round before
    scale: int
    last: bool  # asks for distances and no sums


def _squared(x: Vector, y: Vector) -> int:
    return sum((a - b) * (a - b) for a, b in zip(x, y, strict=True))


def _root(squared: int) -> float:
    try:
        return math.sqrt(squared)
    except OverflowError:
        return math.inf


def _grouped(centroids: list[Vector], n: int) -> list[list[int]]:
    """Centroids in up to n groups: a few rounds over k rows. Which groups these are changes the work, not the result."""
    points = np.array([[float(x) for x in c] for c in centroids])
    points = np.where(np.isfinite(points), points, 0.0) / max(1.0, float(np.abs(points[np.isfinite(points)]).max(initial=0.0)))
    middles = points[np.linspace(0, len(points) - 1, n).astype(int)]
    for _ in range(5):
        of = ((points[:, None, :] - middles[None]) ** 2).sum(2).argmin(1)
        middles = np.array([points[of == g].mean(0) if (of == g).any() else middles[g] for g in range(n)])
    return [x for g in range(n) if (x := np.flatnonzero(of == g).tolist())]


class _Assigner:
    """A round's work on rows of a task."""

    def __init__(self, step: Step) -> None:
        self.step = step
        self.k, self.dim = len(step.centroids), len(step.centroids[0])
        self.c = np.array([[float(x) for x in c] for c in step.centroids])
        self.wide = np.array([any(abs(x) > NARROW for x in c) for c in step.centroids])
        self.norms = (self.c**2).sum(1)
        self.groups = [np.array(g, np.int64) for g in step.groups]
        self.group_of = np.empty(self.k, np.int64)
        for g, of in enumerate(self.groups):
            self.group_of[of] = g
        self.drift = np.array(step.drift)
        self.group_drift = np.array([self.drift[g].max() for g in self.groups])
        self.narrow_sums = np.zeros((self.k, self.dim))
        self.wide_sums: dict[int, Vector] = {}
        self.counts = np.zeros(self.k, np.int64)

    def squared(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of narrow rows to some centroids: exact but for wide centroids."""
        d = (x**2).sum(1)[:, None] - 2.0 * (x @ self.c[of].T) + self.norms[of]
        for j in np.flatnonzero(self.wide[of]):
            d[:, j] = ((x - self.c[of[j]]) ** 2).sum(1)
        return d

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.c[cluster]) ** 2).sum(1)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Moves narrow rows in place; a cluster of -1 is none yet."""
        new = cluster < 0
        upper += np.where(new, 0.0, self.drift[cluster])
        upper[new] = np.inf
        lower -= self.group_drift
        lower[new] = -np.inf
        nearest = lower.min(1)
        todo = np.flatnonzero(~self._beyond(nearest, upper))
        old = todo[~new[todo]]
        upper[old] = np.sqrt(self.own(x[old], cluster[old]))
        todo = todo[~self._beyond(nearest[todo], upper[todo])]
        if len(todo) == 0:
            return
        before = cluster[todo].copy()
        best = np.where(new[todo], np.inf, self.own(x[todo], np.maximum(before, 0)))
        best_at = np.where(new[todo], self.k, before)
        scanned = np.zeros((len(todo), len(self.groups)), bool)
        first, second = np.full(scanned.shape, np.inf), np.full(scanned.shape, np.inf)
        first_at = np.full(scanned.shape, -1, np.int64)
        unsure = np.zeros(len(todo), bool)
        any_wide = bool(self.wide.any())
        for g, of in enumerate(self.groups):
            rows = np.flatnonzero(~self._beyond(lower[todo, g], np.sqrt(best))) if not any_wide else np.arange(len(todo))
            if len(rows) == 0:
                continue
            d = self.squared(x[todo[rows]], of)
            at = d.argmin(1)  # of equals, the smaller number
            m = d[np.arange(len(rows)), at]
            scanned[rows, g], first[rows, g], first_at[rows, g] = True, m, of[at]
            if len(of) > 1:
                second[rows, g] = np.partition(d, 1, axis=1)[:, 1]
            if any_wide:
                unsure[rows] |= (np.isclose(m, best[rows], rtol=SLACK, atol=0) & (of[at] != best_at[rows])) | np.isclose(m, second[rows, g], rtol=SLACK, atol=0) | ~np.isfinite(m)
            better = (m < best[rows]) | ((m == best[rows]) & (of[at] < best_at[rows]))
            best[rows[better]], best_at[rows[better]] = m[better], of[at[better]]
        for r in np.flatnonzero(unsure):
            best_at[r] = self.exact(x[todo[r]])[0]
            best[r] = self.own(x[todo[r : r + 1]], best_at[r : r + 1])[0]
        rest = np.where(first_at == best_at[:, None], second, first)
        lower[todo] = np.where(scanned, np.sqrt(rest), lower[todo])
        moved = np.flatnonzero((before >= 0) & (before != best_at))
        left = self.group_of[before[moved]]
        gone = moved[~scanned[moved, left]]  # a group that was not scanned now holds the centroid left
        if len(gone):
            of = self.group_of[before[gone]]
            lower[todo[gone], of] = np.minimum(lower[todo[gone], of], np.sqrt(self.own(x[todo[gone]], before[gone])))
        cluster[todo], upper[todo] = best_at, np.sqrt(best)

    @staticmethod
    def _beyond(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return lower * (1 - SLACK) > upper * (1 + SLACK) + LEAST

    def exact(self, x: np.ndarray) -> tuple[int, int]:
        """Centroid and squared distance of a row, in whole numbers."""
        whole = [int(v) for v in x]
        d, c = min((_squared(whole, c), i) for i, c in enumerate(self.step.centroids))
        return c, d

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to the rows' centroids as longs; what is beyond a long becomes the largest one."""
        out = np.zeros(len(x), np.int64)
        plain = ~self.wide[cluster] & (np.abs(x).max(1, initial=0) <= NARROW)
        out[plain] = self.own(x[plain], cluster[plain]).astype(np.int64)
        for r in np.flatnonzero(~plain):
            out[r] = min(LONG, _squared([int(v) for v in x[r]], self.step.centroids[cluster[r]]))
        return out

    def count(self, x: np.ndarray, before: np.ndarray, after: np.ndarray, narrow: np.ndarray) -> None:
        """Moves rows that have changed clusters from sum to sum."""
        moved = before != after
        for cluster, sign in ((after, 1), (before, -1)):
            rows = np.flatnonzero(moved & (cluster >= 0))
            np.add.at(self.counts, cluster[rows], sign)
            plain = rows[narrow[rows]]
            np.add.at(self.narrow_sums, cluster[plain], sign * x[plain])
            for r in rows[~narrow[rows]]:
                held = self.wide_sums.setdefault(int(cluster[r]), [0] * self.dim)
                for j, v in enumerate(x[r]):
                    held[j] += sign * int(v)
        if np.abs(self.narrow_sums).max(initial=0) > 1 << 51:  # whole numbers stay exact below 2**53
            for c in range(self.k):
                held = self.wide_sums.setdefault(c, [0] * self.dim)
                self.wide_sums[c] = [h + int(v) for h, v in zip(held, self.narrow_sums[c], strict=True)]
            self.narrow_sums[:] = 0

    def sums(self) -> Iterator[tuple[int, int, int, int]]:
        """Cluster, component (-1: the count), limb and value of what this task has changed."""
        for c in range(self.k):
            if self.counts[c]:
                yield c, -1, 0, int(self.counts[c])
            held = self.wide_sums.get(c, [0] * self.dim)
            for j in range(self.dim):
                value = held[j] + int(self.narrow_sums[c, j])
                sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
                while rest:
                    yield c, j, limb, sign * (rest & ((1 << LIMB) - 1))
                    rest >>= LIMB
                    limb += 1


def _columns(kind: str, vector: str, bounded: bool) -> str:
    state = "cluster int, upper double, lower array<double>, distance long, component int, limb int, total long, kind int"
    return f"id {kind}, v {vector}, {state}" if bounded else f"id {kind}, v {vector}"


def _assigned(step: Step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _Assigner(step)
        groups, seen = len(step.groups), None
        for whole in batches:
            for at in range(0, whole.num_rows, RUN):
                b = whole.slice(at, RUN)
                n, seen = b.num_rows, b
                with np.errstate(over="ignore"):
                    x = np.floor(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * step.scale).reshape(n, a.dim)
                if "cluster" in b.schema.names:
                    cluster = b.column("cluster").to_numpy().astype(np.int64)
                    upper = b.column("upper").to_numpy().copy()
                    lower = b.column("lower").flatten().to_numpy().reshape(n, groups).copy()
                else:
                    cluster, upper, lower = np.full(n, -1, np.int64), np.full(n, np.inf), np.full((n, groups), -np.inf)
                before = cluster.copy()
                narrow = np.abs(x).max(1, initial=0) <= NARROW
                some = np.flatnonzero(narrow)
                c, u, w = cluster[some], upper[some], lower[some]
                a.assign(x[some], c, u, w)
                cluster[some], upper[some], lower[some] = c, u, w
                for r in np.flatnonzero(~narrow):
                    cluster[r] = a.exact(x[r])[0]
                distance = a.distance(x, cluster) if step.last else np.zeros(n, np.int64)
                if not step.last:
                    a.count(x, before, cluster, narrow)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * groups), pa.array(lower.reshape(-1)))
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), lists, pa.array(distance), none, none, pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))],
                    names=["id", "v", "cluster", "upper", "lower", "distance", "component", "limb", "total", "kind"],
                )
        changes = list(a.sums())
        if changes and seen is not None:
            n = len(changes)
            c, j, limb, total = (np.array(x) for x in zip(*changes, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, seen.column("id").type), pa.nulls(n, seen.column("v").type), pa.array(c.astype(np.int32)), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int64())]
                + [pa.array(j.astype(np.int32)), pa.array(limb.astype(np.int32)), pa.array(total.astype(np.int64)), pa.array(np.ones(n, np.int32))],
                names=["id", "v", "cluster", "upper", "lower", "distance", "component", "limb", "total", "kind"],
            )

    return run


def _dropped(spark: SparkSession, path: str | None) -> None:
    """Removes a table of an earlier round, which nothing reads any more."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def integer_vectors(rows: DataFrame, vector: str, row_id: str, dim: int) -> DataFrame:
    """id and v of the rows that take part: dim components, none null or non-finite."""
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    usable = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(row_id).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where(usable)


def clustered(rows: DataFrame, vector: str, row_id: str, *, dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, prefix: str = "2:", groups: int | None = None) -> tuple[DataFrame, list[Vector]]:
    """(id, cluster, distance) of each vector, and the centroids.

    Vectors that are null, of another length, or with a null or non-finite component take no part. The others become
    integers floor(scale * x). The first centroids are the k vectors of least sha256 of prefix and id (a null id is empty text;
    ties, as of repeated rows, go to the lesser vector), all if there are fewer. A round assigns every vector to the nearest
    centroid (ties: the smaller number), then replaces every centroid that has vectors by the floor of their mean; after the last
    round vectors are assigned once more. Repeated rows count each. An empty table has no rows and no centroids. A distance beyond
    a long becomes the largest long. Components up to 2**22 are compared in floating point, where whole numbers of this size
    are exact, larger ones as whole numbers of any length. groups: of centroids, a tenth of k unless given.
    """
    if dim > 64:
        raise ValueError("distances are exact in floating point for 64 components at most")
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    base = integer_vectors(rows, vector, row_id, dim)
    stored = base.schema["v"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = base.orderBy(digest, "v").limit(k).collect()
    centroids: list[Vector] = [[math.floor(scale * x) for x in r.v] for r in first]
    if not centroids:
        return base.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).where("false"), []
    of = _grouped(centroids, min(len(centroids), groups or max(1, k // 10)))
    drift, sums, counts = [0.0] * len(centroids), [[0] * dim for _ in centroids], [0] * len(centroids)
    state, path = base, None
    for r in range(rounds + 1):
        step = Step(centroids, of, drift, scale, r == rounds)
        before, path = path, shared_dir(spark)
        schema = _columns(kind, stored, True)
        state.mapInArrow(_assigned(step), schema).write.partitionBy("kind").parquet(path)
        _dropped(spark, before)
        whole = spark.read.schema(schema).parquet(path)
        if r == rounds:
            return whole.where("kind = 0").select("id", "cluster", "distance"), centroids
        state = whole.where("kind = 0").select("id", "v", "cluster", "upper", "lower")
        for c in whole.where("kind = 1").groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")).toLocalIterator():
            if c.component < 0:
                counts[c.cluster] += c.total
            else:
                sums[c.cluster][c.component] += c.total << (LIMB * c.limb) if c.total >= 0 else -((-c.total) << (LIMB * c.limb))
        moved = [[x // n for x in s] if n else c for s, n, c in zip(sums, counts, centroids, strict=True)]
        drift = [_root(_squared(x, y)) for x, y in zip(centroids, moved, strict=True)]
        centroids = moved
    raise AssertionError


def report(found: DataFrame, centroids: list[Vector]) -> DataFrame:
    """The rows of `clustered` with cluster_inertia, inertia and centroid_sha256: a table of k rows beside them. Sums beyond a long become the largest long."""
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(LONG, sum(totals.values()))
    each = [(c, min(LONG, totals.get(c, 0)), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    known = found.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster")
