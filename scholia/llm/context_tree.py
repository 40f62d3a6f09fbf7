"""LM scoring by context-tree weighting over bytes.

The byte after a context is coded as eight binary decisions. Each decision (a
prefix of bits of the byte) has a context tree of its own over the preceding
bytes, of depth 0 to `depth`. A node holds a Krichevsky-Trofimov estimate of its
bit from the training counts; a node's weighted probability is half its own
estimate's and half the product of its children's, so the mix covers all depths.

A text is its UTF-8 bytes with A-Z lower-cased, then the end mark 0xFF, which
UTF-8 never uses; before its start stand `depth` end marks. Its score is the sum
of log10 of the byte probabilities, its code length -score / log10(2) bits.

Counting (each distinct gram of depth + 1 bytes once a task), summing up the
tree and mixing are distributed. Scoring asks for the probability of every gram
of its texts, met in training or not: the asked grams join the counted ones with
count 0, and the tree is mixed for all of them. A task holds whole subtrees below
three context bytes, one run of them after another; the levels above are sums
over nodes of two context bytes, whose number is bounded whatever the corpus. The probabilities reach the texts as
a broadcast while they are at most `most_broadcast` rows (16 bytes each), and else by an
equi-join with the distinct grams of blocks of texts; both give the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm._spark import written

DEPTH = 5
END = 0xFF
#: Rows of a table that executors may hold whole (16 bytes each).
MOST_BROADCAST = 6_000_000
#: Bytes of the texts whose distinct grams are joined together beyond that.
BLOCK_BYTES = 32 << 20
#: Grams whose subtrees a task mixes at once, unless one subtree has more.
RUN_GRAMS = 400_000
#: Distinct keys that a counting task holds before it hands them on.
HOLD = 1_500_000
LN2 = float(np.log(2.0))
GRAM, WORD = 0, 1


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte of each text and of its end mark, and the offsets of the texts' keys.

    A key is, from its highest byte: the preceding byte, the one before, and so on, then the byte itself.
    """
    n = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    gap = depth + 1
    # a text follows `depth` end marks and has one behind: room for its start, all its bytes and its end
    at = offsets[:-1] + gap * np.arange(n) + depth
    padded = np.full(offsets[-1] + gap * n, END, np.uint8)
    real = np.ones(len(padded), bool)
    lead = (at[:, None] - 1 - np.arange(depth)[None, :]).ravel()
    real[lead] = False
    ends = at + np.diff(offsets)
    real[ends] = False
    padded[real] = data
    wide = padded.astype(np.uint64)
    real[ends] = True
    total = len(wide)
    key = np.zeros(total - depth, np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | wide[depth - back : total - back]
    key = (key << np.uint64(8)) | wide[depth:]
    return key[real[depth:]], np.append(0, np.cumsum(np.diff(offsets) + 1))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift - np.log(x), shift)
        x = np.where(low, x + 1, x)
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series + shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, bit: int):
    """For one bit of the byte, from the deepest level to level `top`: the node of each gram, its zeros, ones and log Pw."""
    symbol = (keys & np.uint64(255)).astype(np.int64)
    prefix = (symbol >> (8 - bit)).astype(np.uint64)
    value = ((symbol >> (7 - bit)) & 1).astype(bool)
    below = None
    out = []
    for d in range(depth, top - 1, -1):
        ctx = keys >> np.uint64(8 * (depth - d + 1))
        node_keys, node, _ = T.distinct((ctx << np.uint64(8)) | prefix)
        n = len(node_keys)
        ones = T.sums_by(np.where(value, counts, 0), node, n)
        zeros = T.sums_by(np.where(value, 0, counts), node, n)
        own = log_kt(zeros, ones)
        if below is None:
            weighted = own
        else:
            child_node, child_weighted = below
            parent = np.zeros(len(child_weighted), np.int64)
            parent[child_node] = node
            weighted = np.logaddexp(own, T.sums_by(child_weighted, parent, n)) - LN2
        out.append((node_keys, node, zeros, ones, own, weighted, value))
        below = (node, weighted)
    return out


def _step(level, deepest: bool, mixed: np.ndarray | None) -> np.ndarray:
    """The gram's bit probability at a level, given the mix of the levels below."""
    _, node, zeros, ones, own, weighted, value = level
    kt = (np.where(value, ones[node], zeros[node]) + 0.5) / (zeros[node] + ones[node] + 1.0)
    if deepest:
        return kt
    stop = np.exp(own - LN2 - weighted)[node]
    return stop * kt + (1 - stop) * mixed


def summaries(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, ...]]:
    """Nodes at level `top`, for each bit: key (context, then bit prefix), zeros, ones, log Pw."""
    return [(level[0], level[2], level[3], level[5]) for level in (_levels(keys, counts, depth, top, bit)[-1] for bit in range(8))]


def sums(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of nodes by their parents: key, zeros, ones, log of the product of the children's Pw."""
    parents, number, _ = T.distinct(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)))  # the oldest context byte goes
    return parents, *(T.sums_by(x, number, len(parents)) for x in (zeros, ones, weighted))


def levels_above(nodes: list[tuple[np.ndarray, ...]], top: int) -> list[list[tuple[np.ndarray, ...]]]:
    """From the sums at level `top` - 1 of the whole tree: for each bit, for levels top-1 to 0, node keys, stop weight and KT probability of a one."""
    out = []
    for at in nodes:
        levels = []
        for d in range(top - 1, -1, -1):
            keys, z, o, below = at
            own = log_kt(z, o)
            w = np.logaddexp(own, below) - LN2
            order = np.argsort(keys)
            levels.append((keys[order], np.exp(own - LN2 - w)[order], ((o + 0.5) / (z + o + 1.0))[order]))
            at = sums(keys, z, o, w)
        out.append(levels)
    return out


def roots(nodes: list[tuple[np.ndarray, ...]], top: int) -> list[list[tuple[np.ndarray, ...]]]:
    """`levels_above` from the summaries at level `top`."""
    return levels_above([sums(*x) for x in nodes], top)


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, above: list[list[tuple[np.ndarray, ...]]]) -> np.ndarray:
    """log10 of each gram's byte probability; the grams hold whole subtrees below level `top`, `above` the levels over it."""
    total = np.zeros(len(keys))
    symbol = (keys & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        mixed = None
        for i, level in enumerate(_levels(keys, counts, depth, top, bit)):
            mixed = _step(level, i == 0, mixed)
        value = ((symbol >> (7 - bit)) & 1).astype(bool)
        prefix = (symbol >> (8 - bit)).astype(np.uint64)
        for d, (node_keys, stop, one) in zip(range(top - 1, -1, -1), above[bit], strict=True):
            ctx = (keys >> np.uint64(8)) >> np.uint64(8 * (depth - d))
            at = T.lookup(node_keys, (ctx << np.uint64(8)) | prefix)
            kt = np.where(value, one[at], 1 - one[at])
            mixed = stop[at] * kt + (1 - stop[at]) * mixed
        total += np.log10(mixed)
    return total


def _counted(depth: int):
    """Grams and words of each task's texts, with their counts in training texts (0: only met in others)."""

    def flush(kind: int, held: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        found, number, _ = T.distinct(keys)
        return found, np.bincount(number, weights=counts, minlength=len(found)).astype(np.int64)

    def batch(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        held: dict[int, list] = {GRAM: [], WORD: []}
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            training = b.column("training").to_numpy(zero_copy_only=False)
            for i, j, part, bounds in T.runs(data, offsets):
                low = T.lower_ascii(part)
                starts, ends, owner = T.tokens(T.is_word(low), bounds)
                keys, of = grams(low, bounds, depth)
                for kind, got, own in ((GRAM, keys, np.repeat(np.arange(j - i), np.diff(of))), (WORD, T.span_hashes(low, starts, ends), owner)):
                    learnt = training[i:j][own]
                    for some, used in ((got[learnt], 1), (got[~learnt], 0)):
                        found, n = np.unique(some, return_counts=True)
                        held[kind].append((found, n * used))
                    if sum(len(k) for k, _ in held[kind]) > HOLD:
                        held[kind] = [flush(kind, held[kind])]
                        if len(held[kind][0][0]) > HOLD // 2:
                            yield batch(kind, *held[kind].pop())
        for kind, some in held.items():
            if some:
                yield batch(kind, *flush(kind, some))

    return run


TOP = 3


def _subtrees(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of runs of whole subtrees, from batches in the order of their keys."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        keys = np.append(keys, b.column("key").to_numpy().view(np.uint64))
        counts = np.append(counts, b.column("n").to_numpy())
        if len(keys) > RUN_GRAMS:
            bound = int(np.searchsorted(keys >> np.uint64(shift), keys[-1] >> np.uint64(shift)))
            if bound:
                yield keys[:bound], counts[:bound]
                keys, counts = keys[bound:], counts[bound:]
    if len(keys):
        yield keys, counts


def _summed(depth: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _subtrees(batches, 8 * (depth - top + 1)):
            for bit, nodes in enumerate(summaries(keys, counts, depth, top)):
                parents, *values = sums(*nodes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parents), bit, np.int8)), pa.array(parents.view(np.int64)), *(pa.array(x) for x in values)], names=["bit", "node", "zeros", "ones", "below"])

    return run


def _mixed(depth: int, top: int, above):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _subtrees(batches, 8 * (depth - top + 1)):
            value = log10_probabilities(keys, counts, depth, top, above.value)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), GRAM, np.int8)), pa.array(keys.view(np.int64)), pa.array(counts), pa.array(value)], names=["kind", "key", "n", "value"])

    return run


class Trained:
    """A model: `counts` (kind, key, n) of grams and words, also of those only met in rows given to `fit` that are not for training (n = 0), and totals."""

    def __init__(self, counts: DataFrame, depth: int, tokens: int, distinct: int, ends: int, smoothing: float) -> None:
        self.counts, self.depth, self.tokens, self.distinct, self.ends = counts, depth, tokens, distinct, ends
        self.offset = float(np.log10(tokens + smoothing * (distinct + 1)))
        self.smoothing = smoothing

    @property
    def end_value(self) -> float:
        return float(np.log10(self.ends + self.smoothing)) - self.offset

    @property
    def top(self) -> int:
        return min(TOP, self.depth)


def fit(docs: DataFrame, text: str, training: Column, *, depth: int = DEPTH, smoothing: float = 0.1) -> Trained:
    """Counts the rows for which `training` holds (null: not); grams and words of the others are noted with count 0. Null texts are empty."""
    source = docs.select(F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = written(source.mapInArrow(_counted(depth), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = source.where("training").count()
    return Trained(counts, depth, total.n + ends, total.v + (ends > 0), ends, smoothing)


def _values(model: Trained, counts: DataFrame) -> DataFrame:
    """kind, key, n, value of all rows of counts, written: log10 probabilities of grams, base probabilities of words."""
    spark, depth, top = counts.sparkSession, model.depth, model.top
    # rows with the same `top` bytes before the coded one are a subtree: in one partition, and next to each other
    shift = 8 * (depth - top + 1)
    tree = counts.where(F.col("kind") == GRAM).select("key", "n").repartition(F.shiftrightunsigned("key", shift)).sortWithinPartitions(F.shiftrightunsigned("key", 1), "key")
    nodes = tree.mapInArrow(_summed(depth, top), "bit byte, node long, zeros double, ones double, below double")
    # at most 65,536 contexts of two bytes, 255 nodes each, whatever the corpus
    rows = nodes.groupBy("bit", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    bits = rows.column("bit").to_numpy()
    at = [tuple((c.view(np.uint64) if name == "node" else c)[bits == b] for name in ("node", "zeros", "ones", "below") for c in [rows.column(name).to_numpy()]) for b in range(8)]
    above = spark.sparkContext.broadcast(levels_above(at, top))
    gram_values = tree.mapInArrow(_mixed(depth, top, above), "kind byte, key long, n long, value double")
    word_values = counts.where(F.col("kind") == WORD).withColumn("value", F.log10(F.col("n") + model.smoothing) - model.offset)
    return written(gram_values.unionByName(word_values))


def _keys_of(low: np.ndarray, bounds: np.ndarray, depth: int):
    starts, ends, owner = T.tokens(T.is_word(low), bounds)
    keys, of = grams(low, bounds, depth)
    return keys, np.repeat(np.arange(len(bounds) - 1), np.diff(of)), T.span_hashes(low, starts, ends), owner


def _summed_up(part: np.ndarray, bounds: np.ndarray, model: tuple[int, float, float], value_of, count_of) -> tuple[np.ndarray, ...]:
    """Words, known words, base and total of each text; value_of and count_of look up grams and words."""
    depth, smoothing, offset = model
    n = len(bounds) - 1
    keys, of, words, owner = _keys_of(T.lower_ascii(part), bounds, depth)
    values, counts = value_of(keys), count_of(words)
    if np.isnan(values).any():
        raise ValueError("a text holds a gram that was not asked for: score it with covered=False")
    return np.bincount(owner, minlength=n), T.sums_by(counts > 0, owner, n).astype(np.int64), T.sums_by(np.log10(counts + smoothing) - offset, owner, n), T.sums_by(values, of, n)


def _results(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, model, value_of, count_of) -> pa.RecordBatch:
    n = len(offsets) - 1
    out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
    for i, j, part, bounds in T.runs(data, offsets):
        for whole, some in zip(out, _summed_up(part, bounds, model, value_of, count_of), strict=True):
            whole[i:j] = some
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), *(pa.array(x) for x in out)], names=["id", "n_bytes", "words", "known", "base", "total"])


def _scored(model: tuple[int, float, float], held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        gram, word = held.value
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            yield _results(b.column("id"), data, offsets, model, lambda k: gram.get(k, np.nan), lambda k: word.get(k, 0.0))

    return run


def _asked(depth: int):
    """Distinct grams and words of a block of texts."""

    def run(texts: pa.Table) -> pa.Table:
        data, offsets = T.buffers(texts.column("text"))
        found: dict[int, list] = {GRAM: [], WORD: []}
        for _, _, part, bounds in T.runs(data, offsets):
            keys, _, words, _ = _keys_of(T.lower_ascii(part), bounds, depth)
            for kind, got in ((GRAM, keys), (WORD, words)):
                found[kind].append(T.distinct(got)[0])
        keys = [T.distinct(np.concatenate([np.zeros(0, np.uint64), *found[kind]]))[0] for kind in (GRAM, WORD)]
        block = np.full(len(keys[0]) + len(keys[1]), texts.column("block")[0].as_py(), np.int32)
        return pa.table({"block": block, "kind": np.repeat(np.array([GRAM, WORD], np.int8), [len(k) for k in keys]), "key": np.concatenate(keys).view(np.int64)})

    return run


def _block_scored(model: tuple[int, float, float], schema: pa.Schema):
    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value, n = (values.column(c).to_numpy() for c in ("kind", "key", "value", "n"))
        gram, word = (T.Values(key[kind == k].view(np.uint64), x[kind == k].astype(np.float64), n[kind == k]) for k, x in ((GRAM, value), (WORD, n)))
        data, offsets = T.buffers(texts.column("text"))
        ids = texts.column("id").combine_chunks()
        return pa.Table.from_batches([_results(ids, data, offsets, model, lambda k: gram.get(k, np.nan), lambda k: word.get(k, 0.0))]).cast(schema)

    return run


def _near(values: DataFrame, value: str, bits: int) -> tuple[pa.Table, pa.Table]:
    """key and value of a table of a checked size, in the order of the keys as unsigned numbers, and the rows of largest count."""
    slim = values.select("key", F.col(value).cast("double").alias("value"), "n")  # as in the join: both ways give the same scores
    return slim.select("key", "value").orderBy(F.col("key") < 0, "key").toArrow(), slim.orderBy(F.desc("n"), "key").limit(1 << bits >> 1).toArrow()


def score(docs: DataFrame, text: str, row_id: str, model: Trained, *, covered: bool = False, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, n_bytes, words, known, base, total for each row: base is the unigram word score, total the context-tree score (log10).

    Every gram of the texts gets its probability in the tree, met in training or not. `covered`: all rows were given to `fit`
    (for training or not), so that their grams are noted already and need no pass of their own; a gram that is not raises an error.
    A null text counts as empty; an empty text has the score of its end mark. Rows are kept as they are, also repeated ones.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    kind_of_id = source.schema["id"].dataType.simpleString()
    schema = f"id {kind_of_id}, n_bytes long, words long, known long, base double, total double"
    counts = model.counts
    if not covered:
        asked = source.select("text", F.lit(False).alias("training")).mapInArrow(_counted(model.depth), "kind byte, key long, n long")
        counts = written(counts.unionByName(asked).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    values = _values(model, counts)
    settings = model.depth, model.smoothing, model.offset
    if values.count() <= most_broadcast:
        gram = T.Values.sorted(*_near(values.where(F.col("kind") == GRAM), "value", 17), 17)
        word = T.Values.sorted(*_near(values.where((F.col("kind") == WORD) & (F.col("n") > 0)), "n", 15), 15)
        scored = source.mapInArrow(_scored(settings, spark.sparkContext.broadcast((gram, word))), schema)
    else:
        bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        numbered = written(source.withColumn("row", F.monotonically_increasing_id()))
        blocks = 1 + (numbered.agg(F.sum(bytes_of)).first()[0] or 0) // BLOCK_BYTES
        dealt = numbered.select("id", "text", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
        asked = dealt.groupBy("block").applyInArrow(_asked(model.depth), "block int, kind byte, key long")
        held = asked.join(values, ["kind", "key"]).select("block", "kind", "key", "value", "n")
        fields = pa.schema([("id", _arrow_kind(source)), ("n_bytes", pa.int64()), ("words", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("total", pa.float64())])
        scored = dealt.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_block_scored(settings, fields), schema)
    return scored.withColumn("words", F.col("words") + 1).withColumn("known", F.col("known") + int(model.ends > 0)).withColumn("base", F.col("base") + model.end_value)


def _arrow_kind(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["id"].dataType)
