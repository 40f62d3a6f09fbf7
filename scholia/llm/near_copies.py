"""Groups of texts that share most of their word shingles.

Texts of equal sets of shingle hashes are one class, so that copies cost nothing. First comes the method of `simhash`:
fingerprints of the shingles, links within a Hamming distance found with its pivot distance table, each verified by the
Jaccard similarity of the whole sets, and their components. Similar sets may have fingerprints further apart than any distance that
tells them from unrelated ones, so that a second search looks for what the first can't show: MinHash bands, BANDS keys of ROWS
minima each, so that a pair of similarity s has a key in common with probability 1 - (1 - s**ROWS)**BANDS (1 - 6e-7 at 0.8).
Classes of equal key are a bucket; buckets of the same classes are one, and those whose classes the first search has connected are done.
In a bucket every link is verified in the same way; the search never compares
what is already connected, so a large group of near copies makes as many links as members, and the components
are those of all verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm import simhash
from scholia.llm._spark import looked_up, matched, written

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 3, 20
#: Links of one class that are verified together.
TOGETHER = 64


def shingle_sets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, rising within each, and where each text's begin."""
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, of))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(begin) - 1)))


def set_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    raw = hashes.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b], simhash.SEED) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], np.uint64)


def band_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that is not empty."""
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for row in range(ROWS):
                salt = T.mix(np.full(1, 1 + band * ROWS + row, np.uint64))
                key = T.mix(key ^ np.minimum.reduceat(T.mix(hashes ^ salt), begin[some]))
            out[:, band] = key
    return out


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            keys, fps, bands, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, part, bounds in T.runs(data, offsets):
                plain, at = simhash.shingle_hashes(part, bounds, words)
                fps.append(simhash.fingerprints_of(plain, at)[:, 0])
                hashes, begin = shingle_sets(plain, at)
                keys.append(set_keys(hashes, begin))
                bands.append(band_keys(hashes, begin).ravel())
                sizes.append(BANDS * (np.diff(begin) > 0))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)), pa.array(np.concatenate(bands).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps)), lists], names=["id", "key", "fp", "bands"])

    return run


def _listed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            for _, _, part, bounds in T.runs(data, offsets):
                hashes, begin = shingle_sets(*simhash.shingle_hashes(part, bounds, words))
                raw = hashes.astype("<u8").tobytes()
                sets = [raw[8 * x : 8 * y] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, begin).view(np.int64)), pa.array(sets, pa.binary())], names=["key", "set"])

    return run


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key of the classes that share a value; the bucket is named by a hash of its classes."""
    some = [(b.column("value").to_numpy(), b.column("key").to_numpy()) for b in batches]
    if not some:
        return
    value, key = (np.concatenate(x) for x in zip(*some, strict=True))
    order = np.lexsort((key, value))
    value, key = value[order], key[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(value)))
    raw = key.tobytes()
    first, size = first[size > 1], size[size > 1]
    names = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * (a + n)], simhash.SEED) for a, n in zip(first.tolist(), size.tolist(), strict=True)], np.uint64)
    at = np.repeat(first - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, size).view(np.int64)), pa.array(key[at])], names=["bucket", "key"])


def connected(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets of at least the similarity, enough to connect what all such links would."""
    size = np.array([len(x) for x in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), size)
    left = np.arange(len(sets))
    froms, tos, queue = [], [], []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        mark = np.zeros(len(words), bool)
        mark[np.searchsorted(words, sets[x])] = True
        both = np.bincount(of[mark[flat]], minlength=len(sets))[left]
        near = left[both >= similarity * (size[x] + size[left] - both) - 1e-9]
        if len(near):
            froms.append(np.full(len(near), x))
            tos.append(near)
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
            stay = np.isin(of, left)
            flat, of = flat[stay], of[stay]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def _verified(similarity: float):
    def run(bucket: pa.Table) -> pa.Table:
        key = bucket.column("key").to_numpy()
        a, b = connected([np.frombuffer(x, "<u8") for x in bucket.column("set").to_pylist()], similarity)
        return pa.table({"a": pa.array(key[a], pa.int64()), "b": pa.array(key[b], pa.int64())})

    return run


def _near_fingerprints(marked: DataFrame, distance: int) -> DataFrame:
    """bucket, key: classes that share a fingerprint or whose fingerprints are within the distance.

    A fingerprint stands for its least class. Links are dealt by that of their classes which has more of them, about TOGETHER to a bucket.
    """
    pairs = marked.select("fp", "key").distinct()
    stands = written(pairs.groupBy("fp").agg(F.min("key").alias("stand"), F.count("*").alias("n")))
    near = simhash.links(stands.select("fp"), distance=distance)
    left, right = stands.select(F.col("fp").alias("a"), F.col("stand").alias("x")), stands.select(F.col("fp").alias("b"), F.col("stand").alias("y"))
    same = looked_up(pairs, stands, "fp", "n").select(F.col("stand").alias("x"), F.col("key").alias("y"))
    found = written(near.join(left, "a").join(right, "b").select("x", "y").unionByName(same).where("x != y").distinct())
    ends = written(found.select(F.explode(F.array("x", "y")).alias("end")).groupBy("end").agg(F.count("*").alias("times")))
    for end in ("x", "y"):
        found = looked_up(found, ends.select(F.col("end").alias(end), "times", F.col("times").alias(f"of_{end}")), end, "times")
    hub, other = (F.when(F.col("of_x") >= F.col("of_y"), F.col(p)).otherwise(F.col(q)) for p, q in (("x", "y"), ("y", "x")))
    part = F.pmod(F.xxhash64(other), F.ceil(F.greatest("of_x", "of_y") / TOGETHER))
    return found.select(F.xxhash64(hub, part).alias("bucket"), F.explode(F.array("x", "y")).alias("key")).distinct()


def _links(slim: DataFrame, classes: DataFrame, buckets: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b: verified links between the classes of each bucket (bucket, key) that connect what all their links would."""
    asked = buckets.select("key").distinct().join(classes, "key").select(F.col("least").alias("id")).distinct()
    sets = matched(slim, "id", asked).select("text").mapInArrow(_listed(words), "key long, set binary")
    return buckets.join(sets, "key").groupBy("bucket").applyInArrow(_verified(similarity), "a long, b long").where("a != b").distinct()


def grouped(docs: DataFrame, text: str, row_id: str, *, words: int = WORDS, similarity: float = SIMILARITY, distance: int = simhash.DISTANCE) -> DataFrame:
    """id, component of each row: the smallest id that links of at least the similarity reach, the row's own included.

    Null and empty texts have the empty set, and are one class. Repeated rows stay; a null id is in no minimum.
    distance: of the fingerprints that are searched first; it changes no result.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    slim = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    marked = written(slim.mapInArrow(_sketched(words), f"id {kind}, key long, fp long, bands array<long>"))
    classes = written(marked.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("times")))
    roots = written(simhash.components(_links(slim, classes, written(_near_fingerprints(marked, distance)), words, similarity)))
    values = marked.select("key", F.explode("bands").alias("value")).distinct()
    buckets = written(values.repartition("value").mapInArrow(_bucketed, "bucket long, key long").distinct())
    rooted = buckets.join(roots, buckets.key == roots.node, "left").select("bucket", F.coalesce("root", "key").alias("root"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
    edges = _links(slim, classes, written(buckets.join(apart, "bucket", "left_semi")), words, similarity)
    roots = simhash.components(edges.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = written(classes.join(roots, classes.key == roots.node, "left").select("key", "least", "times", F.coalesce("root", "key").alias("root")))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root").select("key", "component", "times")
    return looked_up(marked.select("id", "key"), written(named), "key", "times").select("id", "component")


def kept(docs: DataFrame, text: str, row_id: str, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, as it is: that of the smallest id. Rows without an id stay."""
    return simhash.firsts(docs, row_id, grouped(docs.where(F.col(row_id).isNotNull()), text, row_id, words=words, similarity=similarity))
