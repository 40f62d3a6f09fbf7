"""SimHash fingerprints of texts, links at a small Hamming distance, and their components.

A fingerprint is over the XXH64 hashes (seed 42) of word shingles, repeats included. The
candidate search works on distinct fingerprints only, so copies cost nothing. It keeps a
pivot distance table: of each fingerprint, its Hamming distances to many reference
fingerprints. A pair at distance d differs by at most d in every coordinate, on all bits
and on any subset of them. First, on subsets: the 64 bits are cut into blocks; with
distance + k blocks, two fingerprints within the distance agree on all bits of at least
k blocks, where every reference's partial distance is the same. Grouping on equal
partial distances is grouping on the bits of those k blocks, which is what the equi-join
key is. k grows with the number of fingerprints, so that few unrelated ones share a key (about CROWD at most) and
comparisons grow as their number, not its square. Then, in a group, pairs are discarded by their largest difference of coordinates
over all references, and survivors verified by their Hamming distance. (References over all
64 bits alone discard pairs but can't find them short of comparing all: distances of
unrelated fingerprints to any reference lie within a few bits of 32.)

Small groups give every link; a group of more than SMALL fingerprints gives links that
connect the same fingerprints by a search which never compares what is already connected,
so a large group of near copies makes as many links as members, not their square. The
components are therefore those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm._spark import looked_up, matched, written

SEED = 42
WORDS = 4
DISTANCE = 4
REFERENCES = 16
SMALL = 96
#: Unrelated fingerprints of one key at most, on average.
CROWD = 4


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 hashes of the texts' shingles, text after text, and where each text's begin. Fewer words are one shingle."""
    n = len(offsets) - 1
    low = T.lower_ascii(data)
    inside = T.is_word(low)
    starts, ends, owner = T.tokens(inside, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lengths = ends - starts
    at = np.append(0, np.cumsum(lengths + 1))
    joined = np.full(at[-1], 32, np.uint8)
    joined[np.flatnonzero(inside) + np.repeat(at[:-1] - starts, lengths)] = low[inside]
    text = joined.tobytes()
    per = np.bincount(owner, minlength=n)
    first = np.append(0, np.cumsum(per))
    shingles = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
    begin = np.append(0, np.cumsum(shingles))
    of = np.repeat(np.arange(n), shingles)
    i = np.arange(begin[-1]) - begin[of] + first[of]
    j = np.minimum(i + words, first[of + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(at[i].tolist(), (at[j] - 1).tolist(), strict=True)])
    return np.frombuffer(hashes, ">u8").astype(np.uint64), begin


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, tables: int = 1) -> np.ndarray:
    """The unsigned 64-bit fingerprints of each text, a column a table: 0 if it has no words.

    Table 0 is over the shingles' hashes, each other one over a bijective remix of them.
    """
    return fingerprints_of(*shingle_hashes(data, offsets, words), tables)


def fingerprints_of(plain: np.ndarray, begin: np.ndarray, tables: int = 1) -> np.ndarray:
    """The fingerprints of texts whose shingle hashes are there already."""
    out = np.zeros((len(begin) - 1, tables), np.uint64)
    shingles = np.diff(begin)
    some = np.flatnonzero(shingles)
    if len(some) == 0:
        return out
    for t in range(tables):
        h = T.mix(plain ^ T.mix(np.full(1, t, np.uint64))) if t else plain
        bits = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            column = np.ascontiguousarray(bits[:, byte])
            for bit in range(8):
                ones = np.add.reduceat(((column >> (7 - bit)) & 1).astype(np.int32), begin[some])
                out[some, t] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(63 - 8 * byte - bit)
    return out


def _fingerprinted(words: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            out = np.zeros((len(offsets) - 1, tables), np.uint64)
            for i, j, part, bounds in T.runs(data, offsets):
                out[i:j] = fingerprints(part, bounds, words, tables)
            columns = [pa.array(np.ascontiguousarray(out[:, t]).view(np.int64)) for t in range(tables)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", "fp", *(f"fp{t}" for t in range(1, tables))])

    return run


def fingerprint(docs: DataFrame, text: str, row_id: str, *, words: int = WORDS, tables: int = 1) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and fp1, ... of each row. Null and empty texts have fingerprint 0."""
    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(_fingerprinted(words, tables), f"id {kind}, fp long" + "".join(f", fp{t} long" for t in range(1, tables)))


def agreeing(distance: int, n: int) -> int:
    """Blocks that the fingerprints of a band agree on: the least number, two or more, whose bits keep unrelated ones of n apart. With fewer bits than a block needs, no more."""
    k = 2
    while n > CROWD << (64 * k // (distance + k)) and distance + k < 16:
        k += 1
    return k


def blocks(distance: int, k: int = 2) -> list[int]:
    """Masks of distance + k blocks of bits that cover all 64."""
    cuts = np.linspace(0, 64, distance + k + 1).round().astype(int).tolist()
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _band_masks(distance: int, k: int) -> list[np.uint64]:
    return [np.uint64(sum(some)) for some in combinations(blocks(distance, k), k)]


def _keyed(distance: int, k: int):
    masks = _band_masks(distance, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for band, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), band, np.int16)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))], names=["band", "key", "fp"])

    return run


def references(n: int = REFERENCES) -> np.ndarray:
    return T.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.stack([np.bitwise_count(fp ^ r) for r in refs], axis=1).astype(np.int8)


def _survive(table: np.ndarray, a: np.ndarray, b: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those whose coordinates differ by at most the distance, and of these, those within it."""
    for column in range(table.shape[1]):
        if len(a) == 0:
            break
        keep = np.abs(table[a, column] - table[b, column]) <= distance
        a, b = a[keep], b[keep]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
    return a[near], b[near]


def _searched(fp: np.ndarray, table: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect a group's fingerprints as all its links would."""
    left = np.arange(len(fp))
    froms, tos = [], []
    queue: list[int] = []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        keep = left[np.abs(table[left, 0] - table[x, 0]) <= distance]
        a, _ = _survive(table, keep, np.full(len(keep), x), fp, distance)
        if len(a):
            froms.append(np.full(len(a), x))
            tos.append(a)
            queue += a.tolist()
            left = left[~np.isin(left, a, assume_unique=True)]
    return froms, tos


def _first_band(differing: np.ndarray, distance: int, k: int) -> np.ndarray:
    """Number of the first band whose blocks hold none of the differing bits."""
    out = np.full(len(differing), -1, np.int64)
    for band, mask in reversed(list(enumerate(_band_masks(distance, k)))):
        out[(differing & mask) == 0] = band
    return out


def group_links(band: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of equal band and key."""
    order = np.lexsort((fp, key, band))
    band, key, fp = band[order], key[order], fp[order]
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)[group] if n else group
    table = pivot_table(fp, references())
    froms, tos = [], []
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    for shift in range(1, SMALL):
        a = small[small + shift < n]
        a = a[group[a] == group[a + shift]]
        if len(a) == 0:
            break
        x, y = _survive(table, a, a + shift, fp, distance)
        mine = _first_band(fp[x] ^ fp[y], distance, k) == band[x]  # a pair meets in every band it agrees on and counts in the first
        x, y = x[mine], y[mine]
        froms.append(x)
        tos.append(y)
    for start in np.flatnonzero(new & (size > SMALL)):
        part = slice(start, start + size[start])
        a, b = _searched(fp[part], table[part], distance)
        froms += [x + start for x in a]
        tos += [x + start for x in b]
    if not froms:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = fp[np.concatenate(froms)], fp[np.concatenate(tos)]
    return np.minimum(a, b), np.maximum(a, b)


def _linked(distance: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [tuple(b.column(c).to_numpy() for c in ("band", "key", "fp")) for b in batches]
        if some:
            band, key, fp = (np.concatenate(x) for x in zip(*some, strict=True))
            a, b = group_links(band, key, fp.view(np.uint64), distance, k)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, *, distance: int = DISTANCE, n: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that have the components of all links within the distance. n: their number, if it is known."""
    k = agreeing(distance, fps.count() if n is None else n)
    keyed = fps.mapInArrow(_keyed(distance, k), "band short, key long, fp long")
    return keyed.repartition("band", "key").mapInArrow(_linked(distance, k), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node that it reaches.

    Alternates large and small stars until nothing changes; every round is written to the shared folder.
    """
    edges = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b"))
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select("b", "m").toDF("a", "b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a != b").distinct()
        edges = written(small)
    rooted = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return rooted.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _table_edges(marked: DataFrame, column: str, distance: int) -> DataFrame:
    """Edges between values of fp from the links of another table: its fingerprints stand for their least fp."""
    pairs = marked.select("fp", F.col(column).alias("own")).distinct()
    stands = written(pairs.groupBy("own").agg(F.min("fp").alias("rep")))
    same = pairs.join(stands, "own").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    near = links(stands.select(F.col("own").alias("fp")), distance=distance)
    left, right = stands.toDF("a", "x"), stands.toDF("b", "y")
    return same.unionByName(near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b")


def grouped(docs: DataFrame, text: str, row_id: str, *, words: int = WORDS, distance: int = DISTANCE, tables: int = 1) -> DataFrame:
    """id, fp, component of each row: component is the smallest id that links reach, the row's own included.

    With more tables, a link in any of them counts: texts further apart than one fingerprint shows are found too.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay; a null id is in no minimum.
    """
    marked = written(fingerprint(docs, text, row_id, words=words, tables=tables))
    fps = written(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("times")))
    edges = links(fps.select("fp"), distance=distance)
    for t in range(1, tables):
        edges = edges.unionByName(_table_edges(marked, f"fp{t}", distance))
    roots = components(edges.distinct())
    placed = written(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root")))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component", "times")
    return looked_up(marked.select("id", "fp"), written(named), "fp", "times").select("id", "fp", "component")


def kept(docs: DataFrame, text: str, row_id: str, *, words: int = WORDS, distance: int = DISTANCE, tables: int = 1) -> DataFrame:
    """One row of each group, as it is: that of the smallest id. Rows without an id stay."""
    return firsts(docs, row_id, grouped(docs.where(F.col(row_id).isNotNull()), text, row_id, words=words, distance=distance, tables=tables))


def firsts(docs: DataFrame, row_id: str, groups: DataFrame) -> DataFrame:
    """The rows whose id is that of their component, one of each such id; rows without an id stay. Columns may have any names."""
    stay = written(groups.where("id = component").groupBy("id").agg(F.count("*").alias("times")))
    without = docs.where(docs[row_id].isNull())
    repeated = stay.where("times > 1")
    if repeated.isEmpty():
        return matched(docs, row_id, stay).unionByName(without)
    again = matched(docs, row_id, repeated).dropDuplicates([row_id])
    return matched(docs, row_id, stay.where("times = 1")).unionByName(again).unionByName(without)
