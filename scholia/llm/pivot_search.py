"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers floor(scale * x). With M the largest norm, a vector v gets one more coordinate
sqrt(M^2 - |v|^2) and a query q the coordinate 0; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the largest
inner products are the nearest neighbours. Every vector is keyed by its nearest pivot and the distance to it,
sorted by this key, and packed into blocks: an annulus around a pivot each. By the triangle inequality a query at
distance d from the pivot is no nearer to a vector of an annulus [a, b] than max(0, d - b, a - d). A query
first visits the FIRST annuli of least bound, which gives it a k-th score to beat, then the others in the
order of their bounds up to the first that can't reach that score. Scores are exact
integers; bounds leave room for rounding. Pivots are a bounded sample (PIVOTS rows of least hash a
dimension); which rows they are changes the work, not the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm._spark import written

PIVOTS = 48
BLOCK = 256
PACK = 64
FIRST = 3
#: Blocks whose bounds are broadcast (24 bytes each) at most: beyond that, blocks are larger.
MOST_BLOCKS = 1_000_000
#: Bounds (queries times blocks) that a task holds at once.
MOST_BOUNDS = 4_000_000
#: Products below 2**53 are exact in floating point.
EXACT = float(1 << 53)
NO_SCORE = -(1 << 62)
LONG = (1 << 63) - 1


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim) if len(column) else np.zeros((0, dim), np.int64)


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(values * scale).astype(np.int64)  # of narrow vectors: a sum of products fits in a long
            norm = np.add.reduceat(np.append(whole * whole, 0), np.minimum(offsets[:-1], len(whole)))
            norm[np.diff(offsets) == 0] = 0
            raw = [whole[i:j].astype("<i8").tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets).astype(np.int32)), pa.array(norm), pa.array(raw, pa.binary())], names=["id", "dim", "norm", "v"])

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _keyed(pivots, most: float):
    """Nearest pivot and distance of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            near, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                p = pivots.value[dim]
                v = _rows(b.column("v").take(pa.array(at)), dim)
                norm, p_norm = (v * v).sum(axis=1).astype(float), (p * p).sum(axis=1).astype(float)
                more, p_more = np.sqrt(np.maximum(0, most - norm)), np.sqrt(np.maximum(0, most - p_norm))
                square = norm[:, None] + p_norm[None, :] - 2.0 * _product(v, p) + (more[:, None] - p_more[None, :]) ** 2
                near[at] = square.argmin(axis=1)
                dist[at] = np.sqrt(np.maximum(0, square[np.arange(len(at)), near[at]]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("dim"), pa.array(near), pa.array(dist), b.column("v")], names=["id", "dim", "pivot", "dist", "v"])

    return run


def _packed(size: int):
    """Runs of up to `size` rows with the same dimension and pivot, as one row each."""

    def pack(rows: list[tuple]) -> tuple:
        return rows[0][1], rows[0][2], rows[0][3], rows[-1][3], np.array([r[0] for r in rows], "<i8").tobytes(), b"".join(r[4] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "dim", "pivot", "dist", "v")), strict=True):
                if held and (len(held) == size or held[0][1:3] != row[1:3]):
                    out.append(pack(held))
                    held = []
                held.append(row)
            if out:
                yield _batch(out)
        if held:
            yield _batch([pack(held)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        dim, pivot, low, high, ids, vs = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(pivot, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(ids, pa.binary()), pa.array(vs, pa.binary())], names=["dim", "pivot", "low", "high", "ids", "vs"])

    return run


PACKED = "dim int, pivot int, low double, high double, ids binary, vs binary"


def _fewer(packs, shells):
    """Packs of as many queries as their bounds to all blocks leave room for."""
    for dim, ids, vs, floors in packs:
        n, own = len(ids) // 8, max(1, MOST_BOUNDS // len(shells.value[dim][0]))
        for i in range(0, n, own):
            yield dim, ids[8 * i : 8 * (i + own)], vs[8 * dim * i : 8 * dim * (i + own)], floors[8 * i : 8 * (i + own)]


def _visits(pivots, shells, most: float, later: bool):
    """Blocks each pack of queries visits: row pack, block, dim, ids, vs, floor (scores to beat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, vs, floors in _fewer(zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "vs", "floors")), strict=True), shells):
                block, pivot, low, high = shells.value[dim]
                q = np.frombuffer(vs, "<i8").reshape(-1, dim)
                p = pivots.value[dim]
                norm = (q * q).sum(axis=1).astype(float)
                to_pivot = np.sqrt(np.maximum(0, norm[:, None] + most - 2.0 * _product(q, p)))
                d = to_pivot[:, pivot]
                bound = np.maximum(0, np.maximum(d - high[None, :], low[None, :] - d) - 1e-6 * (1 + d))
                first = np.argsort(bound, axis=1, kind="stable")[:, :FIRST]
                if later:
                    floor = np.frombuffer(floors, "<i8")
                    best = (norm[:, None] + most - bound * bound) / 2
                    visit = best + 1e-9 * np.abs(best) + 1 >= floor[:, None]
                    np.put_along_axis(visit, first, False, axis=1)
                else:
                    floor = np.full(len(q), NO_SCORE)
                    visit = np.zeros(bound.shape, bool)
                    np.put_along_axis(visit, first, True, axis=1)
                own = np.frombuffer(ids, "<i8")
                for k in np.flatnonzero(visit.any(axis=0)).tolist():
                    some = visit[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array([int(block[k])]), pa.array([own[some].tobytes()], pa.binary()), pa.array([q[some].astype("<i8").tobytes()], pa.binary()), pa.array([floor[some].astype("<i8").tobytes()], pa.binary())], names=["block", "q_ids", "qs", "floors"])

    return run


def _found(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dim, q_ids, qs, floors, ids, vs in zip(*(b.column(c).to_pylist() for c in ("dim", "q_ids", "qs", "floors", "ids", "vs")), strict=True):
                own, vec = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                score = _product(np.frombuffer(qs, "<i8").reshape(-1, dim), np.frombuffer(vs, "<i8").reshape(-1, dim))
                score = np.where(own[:, None] == vec[None, :], NO_SCORE - 1, score)
                order = np.lexsort((np.broadcast_to(vec, score.shape), -score), axis=1)[:, :k]
                top = np.take_along_axis(score, order, axis=1)
                row, col = np.nonzero(top >= np.frombuffer(floors, "<i8")[:, None])
                out.append((own[row], vec[order[row, col]], top[row, col]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_floors(packs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The packs with each query's k-th score so far; NO_SCORE where it has fewer."""
    floor = first.where(F.col("rank") == k).select("query_id", "score")
    queries = packs.select("pack", F.posexplode("id_list").alias("at", "query_id"))
    floors = queries.join(floor, "query_id", "left").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("score", F.lit(NO_SCORE)).alias("score")))).alias("f"))
    return packs.join(floors.select("pack", F.col("f.score").alias("f")), "pack")


def _floor_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [np.array(x, "<i8").tobytes() for x in b.column("f").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("ids"), b.column("vs"), pa.array(raw, pa.binary())], names=["dim", "ids", "vs", "floors"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = pa.array([np.frombuffer(x, "<i8").tolist() for x in b.column("ids").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pack", "dim", "ids", "vs")), ids], names=["pack", "dim", "ids", "vs", "id_list"])


def top(vectors: DataFrame, vector: str, row_id: str, queries: Column, k: int, *, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    Null vectors, ones that hold a null or a non-finite component, and rows without an id take no part. Vectors are compared with those of
    their own length. Rows with the query's id are its own and no candidates; repeated rows count once. An
    empty table gives no rows. Vectors of components so large that a score might not fit in a long (and only these) meet the queries
    block by block in whole numbers of any length; a score beyond a long counts as the largest or smallest long.
    """
    spark = vectors.sparkSession
    good = F.col(row_id).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x).cast("double") * scale < float("inf")))
    source = vectors.where(good).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    fits = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) * scale + 1 < F.sqrt(F.lit(2.0**62) / F.greatest(F.size("v"), F.lit(1)))
    all_rows, wide = source, source.where(~fits)
    source = source.where(fits)
    beyond = None if wide.isEmpty() else _wide(all_rows, wide, fits, k, scale)
    whole = written(source.select("id", "v").mapInArrow(_integers(scale), "id long, dim int, norm long, v binary"))
    asked = source.where("asks").select("id", "v").mapInArrow(_integers(scale), "id long, dim int, norm long, v binary")
    stats = whole.groupBy("dim").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()  # a row for each length of vectors
    most = float(max((r.most for r in stats), default=0))
    chosen = {}
    for r in stats:
        some = whole.where(F.col("dim") == r.dim).orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
        chosen[r.dim] = _rows(some.column("v").combine_chunks(), r.dim)
    shared = spark.sparkContext.broadcast(chosen)
    keyed_schema = "id long, dim int, pivot int, dist double, v binary"

    def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
        keyed = rows.select("id", "dim", "v").mapInArrow(_keyed(shared, most), keyed_schema)
        # ids last, so that equal vectors spread over partitions too
        ranged = keyed.repartitionByRange("dim", "pivot", "dist", "id").sortWithinPartitions("dim", "pivot", "dist", "id")
        return written(ranged.mapInArrow(_packed(size), PACKED).withColumn(name, F.monotonically_increasing_id()))

    # at most MOST_BLOCKS blocks, but for the last one of each pivot and partition
    blocks = packed(whole, max(BLOCK, -(-sum(r.n for r in stats) // MOST_BLOCKS)), "block")
    packs = packed(asked, PACK, "pack")
    # 24 bytes for each block
    meta = blocks.select("dim", "block", "pivot", "low", "high").toArrow()
    dims = meta.column("dim").to_numpy()
    shells = spark.sparkContext.broadcast({d: tuple(meta.column(c).to_numpy()[dims == d] for c in ("block", "pivot", "low", "high")) for d in np.unique(dims).tolist()})
    visit_schema = "block long, q_ids binary, qs binary, floors binary"
    held = blocks.select("block", "dim", "ids", "vs")
    result_schema = "query_id long, vec_id long, score long"
    start = packs.select("dim", "ids", "vs", F.lit(b"").alias("floors"))
    first = written(_best(start.mapInArrow(_visits(shared, shells, most, False), visit_schema).join(held, "block").mapInArrow(_found(k), result_schema), k))
    listed = packs.select("pack", "dim", "ids", "vs").mapInArrow(_unpacked, "pack long, dim int, ids binary, vs binary, id_list array<long>")
    floored = _with_floors(listed, first, k).mapInArrow(_floor_bytes, "dim int, ids binary, vs binary, floors binary")
    rest = floored.mapInArrow(_visits(shared, shells, most, True), visit_schema).join(held, "block").mapInArrow(_found(k), result_schema)
    found = first.select("query_id", "vec_id", "score").unionByName(rest)
    return _best(found if beyond is None else found.unionByName(beyond), k).select("query_id", "rank", "vec_id", "score")


#: Queries and vectors of a block where one side is wide.
WIDE_QUERIES, WIDE_VECTORS = 16, 64


def _wide(rows: DataFrame, wide: DataFrame, fits: Column, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score of each query's k best among the pairs of which one side is wide: queries by wide vectors, and wide queries by the others, in blocks."""

    def blocks(some: DataFrame, size: int, name: str) -> DataFrame:
        numbered = written(some.select("id", F.size("v").alias("dim"), "v").withColumn("block", F.monotonically_increasing_id()))
        return numbered.groupBy("dim", (F.floor(F.col("block") / size)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name)).select("dim", name)

    asked = rows.where("asks")
    sides = ((asked, wide), (asked.where(~fits), rows.where(fits)))
    found = None
    for queries, vectors in sides:
        both = blocks(queries, WIDE_QUERIES, "q").join(blocks(vectors, WIDE_VECTORS, "x"), "dim").drop("dim").mapInArrow(_wide_found(k, scale), "query_id long, vec_id long, score long")
        found = both if found is None else found.unionByName(both)
    return found


def _wide_found(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda v: [math.floor(scale * x) for x in v]
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                vectors = [(x["id"], whole(x["v"])) for x in r["x"]]
                out = []
                for q in r["q"]:
                    own = whole(q["v"])
                    scored = {(sum(a * c for a, c in zip(own, v, strict=True)), i) for i, v in vectors if i != q["id"]}
                    best = sorted((-min(LONG, max(-LONG - 1, s)), i) for s, i in scored)[:k]
                    out += [(q["id"], i, -s) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run
