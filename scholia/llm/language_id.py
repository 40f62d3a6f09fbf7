"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is its code points, lower-cased; every stretch of other code points than letters is one space.
All n-grams of 1 to 3 of these code points are hashed into a fixed number of buckets. Counts by
language and bucket are summed over all learning rows; the matrix of log probabilities
(buckets x languages) is broadcast; a batch of texts is scored as a sparse product: of each text its buckets' rows, summed.
Beyond MOST languages the matrix is cut into parts of so many, and texts meet one part after the other, so what is
broadcast is bounded and predictions are those of the whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm._spark import written

BITS = 16
#: Languages of a part of the matrix.
MOST = 256
ORDERS = 3
SMOOTHING = 0.5
#: Counts by language and bucket that a counting task holds before it hands them on.
HOLD = 1_000_000
UNKNOWN = "und"
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space; made once in a worker from Unicode's properties."""
    if not _table:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table.append(table)
    return _table[0]


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 texts and the texts' offsets in them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    value = np.where(width == 1, first, first & (0x7F >> width))
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
    return value, np.append(0, np.cumsum(lead))[offsets]


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of the n-grams and the texts they belong to; and which texts have a letter."""
    value, bounds = points(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    kept = _letters()[value]
    space = kept == 32
    has = np.bincount(owner, weights=~space, minlength=len(offsets) - 1) > 0
    stay = np.ones(len(kept), bool)
    stay[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    kept, owner = kept[stay].astype(np.uint64), owner[stay].astype(np.int32)
    out = []
    for order in range(1, ORDERS + 1):
        n = len(kept) - order + 1
        if n <= 0:
            break
        h = np.full(n, np.uint64(order))
        for k in range(order):
            h = h * np.uint64(0x100000001B3) + kept[k : k + n]
        bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        inside = owner[:n] == owner[order - 1 :]
        if order == 1:
            inside &= kept != 32
        out.append((bucket[inside], owner[:n][inside]))
    return out, has


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, number = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return found, T.sums_by(np.concatenate([n for _, n in held]), number, len(found)).astype(np.int64)

        def batch(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            listed = pa.array(list(names), pa.string())
            return pa.RecordBatch.from_arrays([listed.take(pa.array(found >> bits)), pa.array((found & ((1 << bits) - 1)).astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            code = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int64)
            for i, j, part, bounds in T.runs(data, offsets):
                for bucket, owner in hashed(part, bounds, bits)[0]:
                    held.append(np.unique((code[i:j][owner] << bits) + bucket, return_counts=True))
                if sum(len(k) for k, _ in held) > HOLD:
                    held = [summed()]
                    if len(held[0][0]) > HOLD // 2:
                        yield batch(*held.pop())
        if held:
            yield batch(*summed())

    return run


class Part:
    """Log probabilities (buckets x languages) and priors of some of the languages."""

    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray, bits: int) -> None:
        self.langs, self.logs, self.prior, self.bits = langs, logs, prior, bits


class Trained:
    """Priors of all languages; their counts (lang, bucket, n), from which a part of the matrix is made when it is needed."""

    def __init__(self, langs: list[str], prior: np.ndarray, counts: DataFrame, bits: int, smoothing: float) -> None:
        self.langs, self.prior, self.counts, self.bits, self.smoothing = langs, prior, counts, bits, smoothing

    def parts(self) -> Iterator[Part]:
        for start in range(0, len(self.langs), MOST):
            langs = self.langs[start : start + MOST]
            held = self.counts if len(langs) == len(self.langs) else self.counts.where(F.col("lang").between(langs[0], langs[-1]))
            counts = held.toArrow()  # at most MOST languages x 2**bits rows
            matrix = np.full((1 << self.bits, len(langs)), self.smoothing)
            code = {name: k for k, name in enumerate(langs)}
            column = np.array([code[x] for x in counts.column("lang").to_pylist()], np.int64)
            np.add.at(matrix, (counts.column("bucket").to_numpy(), column), counts.column("n").to_numpy())
            logs = np.log(matrix) - np.log(matrix.sum(axis=0))
            yield Part(langs, logs.astype(np.float32), self.prior[start : start + MOST], self.bits)


def fit(docs: DataFrame, text: str, lang: str, *, bits: int = BITS, smoothing: float = SMOOTHING) -> Trained:
    """Learns from all rows with a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    prior = {r.lang: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    # by UTF-8 bytes, as Spark compares strings
    langs = sorted(prior, key=str.encode)
    counts = rows.mapInArrow(_counted(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total = np.array([prior[x] for x in langs], float)
    return Trained(langs, np.log(total / total.sum()) if langs else total, written(counts) if len(langs) > MOST else counts, bits, smoothing)


def _sums(held: Part, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the log probability beside each language; whether it has a letter."""
    data, offsets = T.buffers(texts)
    n = len(offsets) - 1
    sums = np.tile(held.prior, (n, 1))
    known = np.zeros(n, bool)
    for i, j, part, bounds in T.runs(data, offsets):
        grams, known[i:j] = hashed(part, bounds, held.bits)
        for bucket, owner in grams:
            some, number = np.unique(owner, return_index=True)
            if len(some):
                for k in range(len(held.langs)):
                    sums[i + some, k] += np.add.reduceat(held.logs[:, k][bucket], number, dtype=np.float64)
    return sums, known


def _weighed(model, last: bool):
    """Texts with the likeliest language so far, its log probability and the logarithm of the sum of all of them; of the last part the prediction instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        held: Part = model.value
        for b in batches:
            sums, known = _sums(held, b.column("text"))
            best = sums.argmax(axis=1)
            top = sums.max(axis=1)
            every = top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
            names = np.array(held.langs, object)[best]
            if "lang_pred" in b.schema.names:
                before = b.column("top").to_numpy()
                names = np.where(top > before, names, np.array(b.column("lang_pred").to_pylist(), object))
                top, every = np.maximum(top, before), np.logaddexp(every, b.column("every").to_numpy())
            if last:
                score = np.where(known, np.exp(top - every), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.where(known, names, UNKNOWN).tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(names.tolist(), pa.string()), pa.array(top), pa.array(every)], names=["id", "text", "lang_pred", "top", "every"])

    return run


def predict(docs: DataFrame, text: str, row_id: str, model: Trained) -> DataFrame:
    """id, lang_pred, score: the likeliest language and its posterior; `und` and 0 for null texts and those without a letter.

    A model learnt from no rows predicts `und`. Ties go to the first language by name; an empty table gives no rows. Beyond MOST languages the texts
    are written with what is known of them after each part of the matrix but the last.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    if not model.langs:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    left = -(-len(model.langs) // MOST)
    for part in model.parts():
        left -= 1
        shared = docs.sparkSession.sparkContext.broadcast(part)
        if left:
            rows = written(rows.mapInArrow(_weighed(shared, False), f"id {kind}, text string, lang_pred string, top double, every double"))
    return rows.mapInArrow(_weighed(shared, True), f"id {kind}, lang_pred string, score double")
