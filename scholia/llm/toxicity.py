"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters. From all labelled rows come a lexicon (words) and patterns (word beginnings of
PREFIXES bytes) whose smoothed log odds for the toxic label reach ODDS
and which stand almost only in toxic texts (PURITY), LEAST or more; the ENTRIES of most texts at most. Of these an entry stays that finds its share of
toxic texts that no commoner entry finds, as far as a sample of toxic labelled texts shows, so that copies of a text don't bring in all its words. Entries
are dealt by hash to VOTERS voters each; a voter votes toxic if the text holds one of its entries and abstains otherwise. The
last voter votes clean when no other votes.

Label model. The votes of all learning rows, labelled or not, are counted by pattern of votes. Expectation
maximisation estimates every voter's rates under both classes and the share of toxic texts, from these counts.
Then correlations: for each pair of voters, the joint rate under a class beyond the product of their rates;
a voter's evidence is divided by one plus the sum of its correlations to others, and the rates
are estimated again with it. Every pattern of votes has a posterior.

Classifier. What hashed words and word beginnings say of the posterior labels is counted over all learning rows, labelled or not; those that lean to
toxic (LEANS) are the features. A logistic regression on posterior labels is fitted on a bounded sample of labelled rows, those of least hash, SAMPLE at
most; a feature that the sample lacks has its log odds over all rows as weight. It scores texts: what the voters have seen is only
its training label, so the classifier can weigh words which no voter has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm._spark import written

BITS = 18
PREFIXES = (4, 5)
VOTERS = 8
#: Labelled rows that the classifier is fitted on.
SAMPLE = 20_000
#: Labelled ids that executors may hold whole.
MOST_BROADCAST = 1_000_000
#: Entries of the lexicon and patterns at most.
ENTRIES = 20_000
#: Distinct entries that a counting task holds before it hands them on.
HOLD = 1_000_000
ODDS = 2.5
PURITY = 0.9
LEAST = 5
LEANS = 0.8
RIDGE = 0.5
STEPS = 300
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
WORD, START = 0, 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words (lower-cased letters) and word beginnings, their kinds, and their texts; repeats included."""
    low = T.lower_ascii(data)
    starts, ends, owner = T.tokens(_LETTER[low], offsets)
    hashes, owners = [T.span_hashes(low, starts, ends)], [owner]
    for n in PREFIXES:
        long = ends - starts >= n
        hashes.append(T.mix(T.span_hashes(low, starts[long], starts[long] + n) + np.uint64(START)))
        owners.append(owner[long])
    kinds = np.repeat(np.array([WORD] + [START] * len(PREFIXES), np.int8), [len(h) for h in hashes])
    return np.concatenate(hashes), kinds, np.concatenate(owners)


def _pairs(h: np.ndarray, owner: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    pair = np.unique((owner.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    return pair >> bits, pair & ((1 << bits) - 1)


class Voters:
    """Entries of the lexicon and patterns, sorted, with the voter of each."""

    def __init__(self, entries: np.ndarray, kinds: np.ndarray) -> None:
        order = np.argsort(entries)
        self.entries = entries[order]
        self.voter = ((self.entries >> np.uint64(7)) % np.uint64(VOTERS)).astype(np.int64) + VOTERS * kinds[order]

    def votes(self, h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """A text's votes as bits: bit v if voter v votes toxic."""
        out = np.zeros(n, np.int64)
        if len(self.entries):
            small = np.zeros(1 << 16, bool)
            small[(self.entries >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(small[(h >> np.uint64(48)).astype(np.int64)])
            at = T.lookup(self.entries, h[maybe])
            hit = at >= 0
            np.bitwise_or.at(out, owner[maybe[hit]], np.int64(1) << self.voter[at[hit]])
        return out


def _odds_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each entry, the labelled texts that hold it, and the toxic ones; summed in the task."""
    T.forget()

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, kind, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        at, number, _ = T.distinct(h)
        kinds = np.zeros(len(at), np.int8)
        kinds[number] = kind
        return at, kinds, T.sums_by(n, number, len(at)).astype(np.int64), T.sums_by(pos, number, len(at)).astype(np.int64)

    def batch(at: np.ndarray, kinds: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(kinds), pa.array(n), pa.array(pos)], names=["h", "kind", "n", "pos"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        data, offsets = T.buffers(b.column("text"))
        toxic = b.column("y").to_numpy(zero_copy_only=False)
        for i, _, part, bounds in T.runs(data, offsets):
            h, kind, owner = features(part, bounds)
            at, number, _ = T.distinct(h)
            if len(at) == 0:
                continue
            kinds = np.zeros(len(at), np.int8)
            kinds[number] = kind
            pair = np.unique(owner * len(at) + number)
            n = np.bincount(pair % len(at), minlength=len(at))
            held.append((at, kinds, n, np.bincount(pair % len(at), weights=toxic[i + pair // len(at)], minlength=len(at)).astype(np.int64)))
            if sum(len(x[0]) for x in held) > HOLD:
                held = [summed(held)]
                if len(held[0][0]) > HOLD // 2:
                    yield batch(*held.pop())
    if held:
        yield batch(*summed(held))


def _held_by(entries):
    """Which of the entries each toxic text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            rows = b.column("row").to_numpy()
            for i, _, part, bounds in T.runs(data, offsets):
                h, _, owner = features(part, bounds)
                at = T.lookup(entries.value, h)
                hit = np.flatnonzero(at >= 0)
                pair = np.unique(owner[hit] * len(entries.value) + at[hit]) if len(hit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows[i + pair // max(1, len(entries.value))]), pa.array((pair % max(1, len(entries.value))).astype(np.int32))], names=["row", "entry"])

    return run


def _entries(labelled: DataFrame, sampled: DataFrame, total_pos: int, total: int, share: float) -> Voters:
    """Lexicon and patterns of the labelled rows (text, y), chosen by falling count so that each finds toxic texts that none before it finds.

    sampled (row, text): toxic labelled rows, that share of them all, which show what an entry finds; one that they don't show stays. The
    driver holds ENTRIES entries and the sample's pairs with them, both bounded.
    """
    summed = labelled.mapInArrow(_odds_counted, "h long, kind byte, n long, pos long").groupBy("h").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (total_pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (total - total_pos + 1))
    able = summed.where((F.col("pos") >= LEAST) & (odds >= ODDS) & (F.col("pos") >= PURITY * F.col("n"))).orderBy(F.desc("pos"), "h").limit(ENTRIES).toArrow()
    h, kind, pos = able.column("h").to_numpy().view(np.uint64), able.column("kind").to_numpy(), able.column("pos").to_numpy()
    order = np.argsort(h)
    h, kind, pos = h[order], kind[order], pos[order]
    shared = labelled.sparkSession.sparkContext.broadcast(h)
    held = sampled.mapInArrow(_held_by(shared), "row long, entry int").toArrow()
    entry, text = held.column("entry").to_numpy(), held.column("row").to_numpy()
    _, text = np.unique(text, return_inverse=True)
    by = np.argsort(entry, kind="stable")
    entry, text = entry[by], text[by]
    bounds = np.searchsorted(entry, np.arange(len(h) + 1))
    found = np.zeros(int(text.max(initial=-1)) + 1, bool)
    least = max(1, int(np.ceil(LEAST * share)))
    chosen = []
    for e in np.lexsort((h, -pos)).tolist():
        of = text[bounds[e] : bounds[e + 1]]
        if len(of) == 0 or (~found[of]).sum() >= least:
            found[of] = True
            chosen.append(e)
    return Voters(h[chosen], kind[chosen])


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """The posterior of toxic for each pattern of votes (bits), estimated from the counts alone; `prior` is where it starts."""
    m = 2 * VOTERS
    votes = ((patterns[:, None] >> np.arange(m)[None, :]) & 1).astype(float)
    votes = np.column_stack([votes, patterns == 0])  # the clean voter
    share = np.ones(votes.shape[1])
    start = np.where(patterns == 0, 0.02, 0.9)
    posterior = start
    for again in range(2):
        for _ in range(rounds):
            w1, w0 = counts * posterior, counts * (1 - posterior)
            p1, p0 = (w1 @ votes + 0.5) / (w1.sum() + 1), (w0 @ votes + 0.5) / (w0.sum() + 1)
            pi = np.clip((w1.sum() + prior) / (counts.sum() + 1), 1e-4, 1 - 1e-4)
            on, off = np.log(p1 / p0), np.log((1 - p1) / (1 - p0))
            z = np.log(pi / (1 - pi)) + (votes * share) @ on + ((1 - votes) * share) @ off
            posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if again == 0:
            tied = np.zeros((votes.shape[1], votes.shape[1]))
            for w in (counts * posterior, counts * (1 - posterior)):
                p = (w @ votes + 0.5) / (w.sum() + 1)
                joint = (votes * w[:, None]).T @ votes / max(w.sum(), 1e-9)
                sd = np.sqrt(p * (1 - p)) + 1e-9
                tied = np.maximum(tied, np.clip((joint - np.outer(p, p)) / np.outer(sd, sd), 0, 1))
            np.fill_diagonal(tied, 0)
            share = 1 / (1 + tied.sum(axis=1))
    return posterior


def _targets(data: np.ndarray, bounds: np.ndarray, voters: Voters, posterior: dict[int, float]):
    h, _, owner = features(data, bounds)
    n = len(bounds) - 1
    return h, owner, np.array([posterior.get(v, 0.0) for v in voters.votes(h, owner, n).tolist()])


def _leaning(shared):
    """Of each bucket, the texts that hold it, and the sum of their posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        n, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            for _, _, part, bounds in T.runs(data, offsets):
                h, owner, target = _targets(part, bounds, *shared.value)
                row, col = _pairs(h, owner)
                n += np.bincount(col, minlength=1 << BITS)
                pos += np.bincount(col, weights=target[row], minlength=1 << BITS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(pos[at])], names=["bucket", "n", "pos"])

    return run


def _examples(shared, buckets):
    """Posterior and chosen buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        use = np.zeros(1 << BITS, bool)
        use[buckets.value] = True
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            for i, j, part, bounds in T.runs(data, offsets):
                h, owner, target = _targets(part, bounds, *shared.value)
                row, col = _pairs(h, owner)
                row, col = row[use[col]], col[use[col]]
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(target), pa.ListArray.from_arrays(pa.array(at), pa.array(col.astype(np.int32)))], names=["target", "buckets"])

    return run


def train_linear(target: np.ndarray, row: np.ndarray, col: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and intercept of a logistic regression of soft labels on (row, bucket) pairs; buckets without a pair keep the weights given."""
    weights = others.copy()
    if len(target) == 0:
        return weights, -3.0
    base = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    used, code = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log(base / (1 - base)))
    g2w, g2b = np.full(len(w), 1e-6), 1e-6
    for _ in range(STEPS):  # full batches, Adagrad
        z = b + np.bincount(row, weights=w[code], minlength=len(target))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = np.bincount(code, weights=error[row], minlength=len(w)) + RIDGE * w
        gb = error.sum()
        g2w += gw * gw
        g2b += gb * gb
        w -= 0.5 * gw / np.sqrt(g2w)
        b -= 0.5 * gb / np.sqrt(g2b)
    weights[used] = w
    return weights, b


class Trained:
    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights.astype(np.float32), intercept


def _voted(voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            votes = np.zeros(len(offsets) - 1, np.int64)
            for i, j, part, bounds in T.runs(data, offsets):
                h, _, owner = features(part, bounds)
                votes[i:j] = voters.value.votes(h, owner, j - i)
            at, n = np.unique(votes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["votes", "n"])

    return run


def fit(docs: DataFrame, text: str, row_id: str, labels: DataFrame, label: str, *, sample: int = SAMPLE) -> Trained:
    """Learns from the rows given: texts of all, labels (0 or 1, by the same id) of some. Without any toxic label nothing is toxic.

    Null texts are empty; rows without an id have no label; labels of one id that differ are outvoted (a tie is toxic); repeated rows count as often as they are there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    # ids and labels are joined where the texts are, while they are few enough; texts are shuffled for them only beyond that
    marks = written(marks)
    few = marks.count() <= MOST_BROADCAST
    known = rows.join(F.broadcast(marks) if few else marks, "id")
    counted = known.select("y").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("pos")).first()
    order = F.xxhash64("id", F.lit(7))
    # ids first, of which there are `sample` at most, then their texts
    picked = rows.select("id").distinct().join(F.broadcast(marks) if few else marks, "id").orderBy(order, "id").limit(sample)
    chosen = written(rows.join(F.broadcast(picked), "id").select(F.monotonically_increasing_id().alias("row"), "text", "y"))
    share = min(1.0, sample / max(1, counted.n))
    voters = _entries(known.select("text", "y"), chosen.where("y > 0").select("row", "text"), int(counted.pos), counted.n, share)
    shared = spark.sparkContext.broadcast(voters)
    votes = rows.select("text").mapInArrow(_voted(shared), "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    votes = votes.toArrow()  # one row for each pattern of votes, 2**16 at most
    patterns, counts = votes.column("votes").to_numpy(), votes.column("n").to_numpy().astype(float)
    prior = counted.pos / counted.n if counted.n else 0.0
    posterior = dict(zip(patterns.tolist(), label_model(patterns, counts, prior).tolist(), strict=True)) if len(patterns) and counted.pos else {}
    model = spark.sparkContext.broadcast((voters, posterior))
    sums = rows.select("text").mapInArrow(_leaning(model), "bucket int, n double, pos double").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    sums = sums.toArrow()  # 2**BITS rows at most
    n, pos, bucket = (sums.column(c).to_numpy() for c in ("n", "pos", "bucket"))
    base = min(1 - 1e-3, max(1e-3, sum(posterior.get(p, 0.0) * c for p, c in zip(patterns.tolist(), counts.tolist(), strict=True)) / max(1.0, counts.sum())))
    odds = np.log((pos + base) / (n - pos + (1 - base))) - np.log(base / (1 - base))
    leans = (pos >= LEAST) & (odds > ODDS) & (pos >= LEANS * n)
    start = np.zeros(1 << BITS)
    start[bucket[leans]] = odds[leans]
    use = spark.sparkContext.broadcast(np.sort(bucket[leans]))
    examples = chosen.select("text").mapInArrow(_examples(model, use), "target double, buckets array<int>").toArrow()  # the sample's
    if examples.num_rows == 0:
        return Trained(start, -3.0)
    lists = examples.column("buckets").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return Trained(*train_linear(examples.column("target").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), start))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        held: Trained = model.value
        for b in batches:
            data, offsets = T.buffers(b.column("text"))
            z = np.full(len(offsets) - 1, held.intercept)
            for i, j, part, bounds in T.runs(data, offsets):
                h, _, owner = features(part, bounds)
                weighed = np.flatnonzero(held.weights[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                row, col = _pairs(h[weighed], owner[weighed])
                z[i:j] += np.bincount(row, weights=held.weights[col], minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return run


def score(docs: DataFrame, text: str, row_id: str, model: Trained) -> DataFrame:
    """id, score for each row; null and empty texts have the score of no evidence."""
    kind = docs.schema[row_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(_scored(shared), f"id {kind}, score double")


def clean(docs: DataFrame, text: str, model: Trained, *, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, as they are: also repeated ones, null ids, and columns of any name.

    Null and empty texts have the score of no evidence, and stay unless that is over the threshold; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = _scored(shared)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.schema.get_field_index(text)
            plain = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(column)], names=["id", "text"])
            scores = np.concatenate([x.column("score").to_numpy() for x in run(iter([plain]))])
            yield b.filter(pa.array(scores < threshold))

    return docs.mapInArrow(kept, docs.schema)
