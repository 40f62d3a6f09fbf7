"""Benchmark decontamination by templates.

Texts become tokens: runs of letters, and numbers. Numbers, names and units become typed
placeholders: a number is digits, with single dots or commas between digits; a name a
capitalised word that does not begin a sentence or a line; a unit a word of UNITS after a
number. Windows of WINDOW canonical tokens are hashed and meet the benchmark's windows in an
equi-join. For every document, item and alignment, a window with the item's own fillers counts as
it stands. One with other fillers counts if they map one to one: a filler that stands for two others
in the alignment, or two for one, makes the windows that hold it drop out, and only those, so a
re-parameterised question is caught, and a text that merely has the same shape with clashing
fillers is not. A document leaks an item if such windows cover at least COVERAGE of the item's, or
if it holds a verbatim run of RUN tokens of the item (canonical tokens with the item's fillers).

A window with fewer than half its tokens literal would match anything of its shape: it keeps
its fillers instead of placeholders. An item shorter than a window is one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm._spark import matched

WINDOW = 8
COVERAGE = 0.5
#: A verbatim run of so many tokens is a leak, however long the item is.
RUN = 13
#: Bits of the fixed-size map that lets a window of a document pass to the join.
MAP_BITS = 22
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hr", "ms", "hz", "khz", "mhz", "w", "kw", "v", "kv", "a", "j", "kj", "n", "pa", "kpa", "k", "c", "f", "meters", "metres", "miles", "inches", "feet", "seconds", "minutes", "hours", "days", "years", "dollars", "euros", "percent", "grams", "kilograms", "litres", "liters", "degrees")

SEPARATOR, LETTER, DIGIT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
_CLASS[48:58] = DIGIT
_P = np.uint64(0xD1342543DE82EF95)
NUM, NAME, UNIT = np.uint64(0xA5A5A5A5A5A5A501), np.uint64(0xA5A5A5A5A5A5A503), np.uint64(0xA5A5A5A5A5A5A505)


def _unit_hashes() -> np.ndarray:
    data, offsets = T.buffers(pa.array(list(UNITS)))
    return np.sort(T.span_hashes(data, offsets[:-1], offsets[1:]))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical token hashes, fillers (0 for literal tokens) and text numbers."""
    kind = _CLASS[data]
    # a dot or comma between two digits belongs to the number
    joint = np.zeros(len(data), bool)
    if len(data) > 2:
        joint[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)
    number = (kind == DIGIT) | joint
    edges = offsets
    s1, e1, o1 = T.tokens(kind == LETTER, edges)
    s2, e2, o2 = T.tokens(number, edges)
    low = T.lower_ascii(data)
    starts, ends, owner = np.concatenate([s1, s2]), np.concatenate([e1, e2]), np.concatenate([o1, o2])
    numeric = np.concatenate([np.zeros(len(s1), bool), np.ones(len(s2), bool)])
    order = np.argsort(starts)
    starts, ends, owner, numeric = starts[order], ends[order], owner[order], numeric[order]
    hashes = T.span_hashes(low, starts, ends)
    n = len(starts)
    if n == 0:
        return hashes, hashes, owner
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    # a sentence or line begins where ., !, ?, : or a line end stands since the token before
    breaks = np.cumsum(np.isin(data, np.frombuffer(b".!?:\n\r", np.uint8)) & ~joint)
    breaks = np.append(0, breaks)
    begins = first.copy()
    begins[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    upper |= (data[starts] == 0xC3) & (data[np.minimum(starts + 1, len(data) - 1)] < 0x9F)
    name = upper & ~begins & ~numeric
    unit = np.zeros(n, bool)
    unit[1:] = numeric[:-1] & ~numeric[1:] & ~first[1:]
    unit &= T.lookup(_unit_hashes(), hashes) >= 0
    name &= ~unit
    slots = np.where(numeric | name | unit, hashes, np.uint64(0))
    tokens = np.where(numeric, NUM, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    return tokens, slots, owner


def windows(tokens: np.ndarray, slots: np.ndarray, owner: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every window of `size` tokens inside a text."""
    count = len(tokens) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    literal = np.append(0, np.cumsum(slots == 0))
    templated = 2 * (literal[size:] - literal[:-size]) >= size
    shaped = np.zeros(count, np.uint64)
    exact = np.full(count, np.uint64(1))
    plain = np.where(slots == 0, tokens, slots)
    for i in range(size):
        shaped = shaped * _P + tokens[i : i + count]
        exact = exact * _P + plain[i : i + count]
    at = np.flatnonzero(owner[:count] == owner[size - 1 :])
    return at, T.mix(np.where(templated, shaped, exact) + np.uint64(size))[at]


def _windowed(sizes: list[int], passing, whole_short: bool):
    """Windows (id, text length in windows, position, size, hash, slots). passing: the map, or None for all."""
    bits = None if passing is None else passing.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            ids = b.column("id")
            for i, j, part, bounds in T.runs(data, offsets):
                tokens, slots, owner = canonical(part, bounds)
                first = np.searchsorted(owner, np.arange(j - i))
                length = np.bincount(owner, minlength=j - i)
                for size in sizes:
                    at, hashes = windows(tokens, slots, owner, j - i, size)
                    keep = np.ones(len(at), bool)
                    if bits is not None:
                        low = hashes & np.uint64((1 << MAP_BITS) - 1)
                        keep = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    if whole_short:  # shorter sizes are for items of that length only
                        keep &= (size == WINDOW) | (length[owner[at]] == size)
                    at, hashes = at[keep], hashes[keep]
                    own = owner[at]
                    held = slots[at[:, None] + np.arange(size)[None, :]].view(np.int64) if len(at) else np.zeros((0, size), np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(held.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(i + own)), pa.array((length[own] - size + 1).astype(np.int32)), pa.array((at - first[own]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(hashes.view(np.int64)), lists],
                        names=["id", "windows", "at", "size", "hash", "slots"],
                    )

    return run


def leaks(docs: DataFrame, text: str, row_id: str, items: DataFrame, item_text: str, item_id: str, *, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """id, item_id, coverage of each row that leaks an item: at least `coverage` of the item's windows, verbatim or with consistent slots, or a verbatim run of `run` tokens.

    Null and empty texts, and items without a token, leak nothing; equal items leak together; rows with
    the same id count as one document. Empty tables give no rows. Rows without an id are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    schema = "id {}, windows int, at int, size int, hash long, slots array<long>"
    source = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    benchmark = source.mapInArrow(_windowed(list(range(1, WINDOW + 1)), None, True), schema.format(item_kind)).select(
        F.col("id").alias("item_id"), F.col("windows").alias("item_windows"), F.col("at").alias("item_at"), "size", "hash", F.col("slots").alias("item_slots")
    )
    sizes = sorted(r[0] for r in benchmark.select("size").distinct().toLocalIterator())  # at most WINDOW
    # a map of fixed size: at most 2**MAP_BITS numbers whatever the benchmark
    low = benchmark.select(F.col("hash").bitwiseAND((1 << MAP_BITS) - 1).alias("low")).distinct().toArrow().column("low").to_numpy()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[low] = True
    passing = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    source = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    found = source.mapInArrow(_windowed(sizes, passing, False), schema.format(kind)).drop("windows")
    pairs = found.join(benchmark, ["hash", "size"]).withColumn("shift", F.col("at") - F.col("item_at"))
    slotted = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: (x["a"] != 0) | (x["b"] != 0))
    aligned = pairs.select("id", "item_id", "item_windows", "size", "shift", F.struct(F.col("item_at").alias("at"), F.array_distinct(slotted).alias("pairs")).alias("window"))
    # all lists are bounded by an item's windows
    held = aligned.groupBy("id", "item_id", "item_windows", "size", "shift").agg(F.collect_set("window").alias("windows"))
    clashing = held.withColumn("all", F.array_distinct(F.flatten("windows.pairs"))).withColumn("clash", F.array_union(_shared("all", "a"), _shared("all", "b")))
    verbatim = lambda w: F.forall(w["pairs"], lambda p: p["a"] == p["b"])
    judged = clashing.select(
        "id",
        "item_id",
        "item_windows",
        F.transform(F.filter("windows", lambda w: verbatim(w) | ~F.arrays_overlap(w["pairs"], F.col("clash"))), lambda w: w["at"]).alias("ats"),
        F.array_sort(F.transform(F.filter("windows", verbatim), lambda w: w["at"])).alias("same"),
        (F.lit(run) - F.col("size")).alias("more"),
    )
    # sorted distinct places: a run of windows stands where the place `more` further on is `more` larger
    ran = F.exists(F.transform("same", lambda x, i: (i >= F.col("more")) & (x - F.get("same", i - F.col("more")) == F.col("more"))), lambda x: x)
    covered = judged.withColumn("ran", (F.col("more") >= 0) & ran).groupBy("id", "item_id", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.max("ran").alias("ran"))
    return covered.withColumn("coverage", F.col("n") / F.col("item_windows")).where((F.col("coverage") >= coverage) | F.col("ran")).select("id", "item_id", "coverage")


def _shared(pairs: str, side: str) -> Column:
    """Pairs of a list that share their filler on one side with another pair of it."""
    other = "b" if side == "a" else "a"
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p[side].alias("x"), p[other].alias("y"))))
    beside = F.transform(ordered, lambda p, i: F.struct(p.alias("p"), (F.coalesce(F.get(ordered, i - 1)["x"] == p["x"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["x"] == p["x"], F.lit(False))).alias("shared")))
    named = lambda p: F.struct((p["x"] if side == "a" else p["y"]).alias("a"), (p["y"] if side == "a" else p["x"]).alias("b"))
    return F.transform(F.filter(beside, lambda z: z["shared"]), lambda z: named(z["p"]))


def clean(docs: DataFrame, text: str, row_id: str, items: DataFrame, item_text: str, item_id: str, **options) -> DataFrame:
    """The rows that leak no item, as they are; rows without an id stay."""
    return matched(docs, row_id, leaks(docs, text, row_id, items, item_text, item_id, **options).select("id").distinct(), "left_anti")
