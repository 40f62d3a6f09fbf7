"""Entities and relations of texts without a service: a tagger that learns from unlabelled text, noun phrases, and subject-verb-object triples.

A sentence is a chain of words, each shown as a symbol: a function word stands for itself, any other word for its last three letters, so there are few
symbols whatever the corpus. A hidden Markov model gives each word a tag. It begins from what function words and endings suggest and is fitted by expectation
and maximisation: tasks sum expected counts over all sentences, the driver holds tables of symbols by tags. Tags are the likeliest sequence.

Symbols have fixed numbers, so sentences are read once, written as numbers of two bytes, and every round reads these. Tasks work on batches word by word: all first
words, all second words and so on, longer sentences before shorter ones, so that those that go on stand side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.sources import shared

TAGS = ("noun", "verb", "adjective", "determiner", "preposition", "other")
NOUN, VERB, ADJECTIVE, DETERMINER, PREPOSITION, OTHER = range(6)
# Function words by tag.
FUNCTION = {
    DETERMINER: ("a", "an", "the", "this", "that", "these", "those", "its", "their", "our", "your", "my", "her", "his", "each", "every", "some", "any", "no", "all", "both"),
    PREPOSITION: ("of", "in", "on", "at", "by", "for", "from", "into", "with", "to", "over", "under", "through", "between", "about", "against", "during", "without", "within", "after", "before", "upon", "near"),
    VERB: ("is", "are", "was", "were", "be", "been", "am", "has", "have", "had", "becomes", "became"),
    OTHER: ("and", "or", "but", "if", "because", "while", "when", "where", "which", "who", "whom", "whose", "what", "why", "how", "it", "they", "there", "here", "we", "you", "i", "he", "she", "them", "us", "me", "him", "not", "very", "also", "then", "as", "so", "than", "too"),
}
# Endings that suggest a tag.
ENDINGS = {
    NOUN: ("tion", "sion", "ment", "ness", "ity", "ism", "ence", "ance", "ogy", "age", "ure", "dom", "ist"),
    VERB: ("ize", "ise", "ify", "ates", "ses", "ves", "rms", "ces", "ins", "cts", "ends", "uces"),
    ADJECTIVE: ("ous", "ful", "ive", "ble", "cal", "ial", "nal", "ant", "ary", "ish", "less"),
    OTHER: ("ly",),
}
# Forms that all mean one predicate, verbs that say nothing, and words that name no concept.
COPULAS = ("be", "am", "is", "are", "was", "were", "been", "being", "become", "becomes", "became")
HAVING = ("has", "have", "had")
WEAK = (
    "call", "choose", "come", "complete", "copy", "discuss", "do", "does", "draw", "explain", "fill", "find", "get", "give", "go", "guess", "identify", "imagine", "keep", "know", "learn", "let", "list", "look", "make", "mark",
    "match", "mean", "mention", "need", "note", "observe", "put", "read", "refer", "remember", "say", "see", "show", "solve", "take", "tell", "think", "use", "want", "write",
)
#: Likelihood of one tag after another to begin with (rows: before), and of the first tag.
AFTER = np.array([[2, 5, 0.5, 0.5, 3, 2], [2, 0.5, 2, 5, 3, 2], [8, 0.5, 1, 0.2, 0.5, 0.5], [8, 0.2, 4, 0.1, 0.1, 0.3], [5, 0.3, 2, 6, 0.2, 0.5], [3, 3, 2, 3, 1, 2]])
FIRST = np.array([3, 0.5, 1.5, 6, 1, 2])
WORD = "([\\p{L}][\\p{L}'-]*)"
KNOWN = tuple(sorted(w for words in FUNCTION.values() for w in words))
LETTERS = "abcdefghijklmnopqrstuvwxyz#"


class Tagger(NamedTuple):
    """Symbols in order, and probabilities: of the first tag, of a tag after another, of a symbol in a tag (tags x symbols; the last column: any other symbol)."""

    symbols: list[str]
    first: np.ndarray
    after: np.ndarray
    shown: np.ndarray


def sentences(text: Column) -> Column:
    """Arrays of lower-cased words, one for each sentence or line that has any."""
    parts = F.split(F.lower(text), "[.!?\\n\\r]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(1))), lambda w: F.size(w) > 0)


@cache
def _every() -> list[str]:
    """All symbols there can be, by number: function words as they are, else a dash and the last three letters, letters beyond a-z as #."""
    return [*KNOWN, *("-" + "".join(x) for n in (1, 2, 3) for x in itertools.product(LETTERS, repeat=n))]


def _begun(symbols: list[str]) -> np.ndarray:
    """Counts of symbols in tags to begin with: a function word has its tag, an ending leans to one."""
    shown = np.zeros((len(TAGS), len(symbols) + 1))
    own = {w: t for t, words in FUNCTION.items() for w in words}
    for i, s in enumerate(symbols):
        if s in own:
            shown[own[s], i] = 1.0
        else:
            shown[[NOUN, VERB, ADJECTIVE, OTHER], i] = (2.0, 1.0, 0.6, 0.2)
            for tag, endings in ENDINGS.items():
                if any(e[-3:] == s[1:] if len(e) >= 3 else s.endswith(e) for e in endings):
                    shown[tag, i] += 4.0
    shown[[NOUN, VERB, ADJECTIVE, OTHER], -1] = (2.0, 1.0, 0.6, 0.2)
    return shown


def _normed(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(-1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts, float), where=total > 0)


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the symbols of all words, and the sentences' numbers of words."""
    words = column.flatten()
    known = pc.index_in(words, value_set=pa.array(KNOWN)).fill_null(-1).to_numpy(zero_copy_only=False)
    ends = pc.utf8_slice_codeunits(words, start=-3, stop=None).dictionary_encode()
    other = pc.index_in(pc.replace_substring_regex(ends.dictionary, "[^a-z]", "#"), value_set=pa.array([x[1:] for x in _every()[len(KNOWN) :]])).to_numpy(zero_copy_only=False)
    rest = (other + len(KNOWN))[ends.indices.to_numpy(zero_copy_only=False)] if len(other) else known
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(known >= 0, known, rest).astype(np.int16), sizes.astype(np.int64)


def _laid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words by their number in the sentence, longer sentences first, and how many sentences have a word of each number."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    active = len(sizes) - np.cumsum(np.bincount(sizes))[:-1] if len(sizes) else np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(starts[:n] + t for t, n in enumerate(active.tolist()))]), active


def _table(tagger: Tagger) -> np.ndarray:
    """Probabilities of all symbols there can be (tags x symbols)."""
    number = {x: i for i, x in enumerate(_every())}
    out = np.repeat(tagger.shown[:, -1:], len(number), 1)
    out[:, [number[x] for x in tagger.symbols]] = tagger.shown[:, :-1]
    return out


def expected(tagger: Tagger, table: np.ndarray, codes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first tags, of pairs of tags and of tags by word (tags x words), and the log likelihood, for words as `_laid` has them."""
    at = (np.cumsum(active) - active).tolist()
    n = [*active.tolist(), 0]
    seen = np.take(table, codes, axis=1)
    forward, scale = np.empty_like(seen), np.empty(len(codes))
    turned = np.ascontiguousarray(tagger.after.T)
    for t, a in enumerate(at):
        b = a + n[t]
        now = (turned @ forward[:, at[t - 1] : at[t - 1] + n[t]] if t else tagger.first[:, None]) * seen[:, a:b]
        scale[a:b] = np.maximum(now.sum(0), 1e-300)
        np.divide(now, scale[a:b], out=forward[:, a:b])
    tags, pairs, back = forward.copy(), np.zeros_like(tagger.after), np.zeros((len(TAGS), 0))
    for t in range(len(at) - 2, -1, -1):
        a, m, behind = at[t], n[t + 1], slice(at[t + 1], at[t + 1] + n[t + 1])
        coming = seen[:, behind] / scale[behind]
        coming[:, : back.shape[1]] *= back
        pairs += tagger.after * (forward[:, a : a + m] @ coming.T)
        back = tagger.after @ coming
        tags[:, a : a + m] *= back
    return tags[:, : n[0]].sum(1), pairs, tags, float(np.log(scale).sum())


def likeliest(tagger: Tagger, table: np.ndarray, codes: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Tags of words as `_laid` has them (ties: the earlier tag)."""
    with np.errstate(divide="ignore"):
        first, after, seen = np.log(tagger.first), np.log(tagger.after), np.take(np.log(table), codes, axis=1)
    at, n = (np.cumsum(active) - active).tolist(), [*active.tolist(), 0]
    back, out = np.zeros(seen.shape, np.int8), np.empty(len(codes), np.int8)
    best = first[:, None] + seen[:, : n[0]]
    for t in range(1, len(at)):
        own = slice(at[t], at[t] + n[t])
        before, most = best[:, : n[t]], best[0, : n[t]] + after[0][:, None]
        for i in range(1, len(TAGS)):
            way = before[i] + after[i][:, None]
            back[:, own][way > most] = i
            np.maximum(most, way, out=most)
        best[:, : n[t]] = most + seen[:, own]
    tag = best.argmax(0)
    for t in range(len(at) - 1, -1, -1):
        m = n[t + 1]
        if m:
            tag[:m] = back[tag[:m], at[t + 1] + np.arange(m)]
        out[at[t] : at[t] + n[t]] = tag[: n[t]]
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, sizes = _numbered(b.column("words"))
        places, active = _laid(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([codes[places].astype("<i2").tobytes()]), pa.array([active.astype("<i4").tobytes()])], names=["codes", "active"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for codes, active in zip(b.column("codes"), b.column("active"), strict=True):
            if len(codes.as_buffer()):
                yield np.frombuffer(codes.as_buffer(), "<i2"), np.frombuffer(active.as_buffer(), "<i4").astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = np.zeros(len(_every()), bool)
    for codes, _ in _read(batches):
        met[codes] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met).astype(np.int32))], names=["code"])


def _counted(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, k = _table(tagger), len(TAGS)
        first, after, shown, fit = np.zeros(k), np.zeros((k, k)), np.zeros(table.shape), 0.0
        for codes, active in _read(batches):
            f, p, tags, likely = expected(tagger, table, codes, active)
            first, after, fit = first + f, after + p, fit + likely
            for own, share in zip(shown, tags, strict=True):
                own += np.bincount(codes, share, len(own))
        j, i = np.nonzero(shown)
        kind = np.concatenate([np.zeros(k), np.ones(k * k), np.full(len(i), 2), [3]]).astype(np.int32)
        row = np.concatenate([np.zeros(k), np.repeat(np.arange(k), k), i, [0]]).astype(np.int32)
        column = np.concatenate([np.arange(k), np.tile(np.arange(k), k), j, [0]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(row), pa.array(column), pa.array(np.concatenate([first, after.ravel(), shown[j, i], [fit]]))], names=["kind", "row", "col", "n"])

    return run


def learnt(rows: DataFrame, rounds: int = 8, smoothing: float = 0.1) -> tuple[Tagger, list[float]]:
    """The tagger fitted to sentences (column words), and the log likelihood before each round. Tables are those of symbols, whose number does not grow with the texts."""
    coded = shared.written(rows.select("words").mapInArrow(_written, "codes binary, active binary"))
    every = _every()
    symbols = sorted(every[r.code] for r in coded.mapInArrow(_met, "code int").distinct().toLocalIterator())  # at most 27**3 endings, shorter ones and the function words
    place = np.zeros(len(every), int)
    place[[every.index(x) for x in symbols]] = np.arange(len(symbols))
    shown = _begun(symbols)
    tagger = Tagger(symbols, _normed(FIRST), _normed(AFTER), _normed(shown))
    held, fits = shown > 0, []
    for _ in range(rounds):
        counts = coded.mapInArrow(_counted(tagger), "kind int, row int, col int, n double").groupBy("kind", "row", "col").agg(F.sum("n").alias("n")).toArrow()
        kind, row, col, n = (counts.column(c).to_numpy() for c in ("kind", "row", "col", "n"))
        first, after, new = np.zeros(len(TAGS)), np.zeros((len(TAGS), len(TAGS))), np.zeros_like(shown)
        first[col[kind == 0]] = n[kind == 0]
        after[row[kind == 1], col[kind == 1]] = n[kind == 1]
        new[col[kind == 2], place[row[kind == 2]]] = n[kind == 2]
        fits.append(float(n[kind == 3].sum()))
        # what a tag may show stays as it began; the beginning also keeps tags from changing their meaning
        tagger = Tagger(symbols, _normed(first + smoothing * FIRST), _normed(after + smoothing * AFTER), _normed(np.where(held, new + smoothing * shown, 0.0)))
    return tagger, fits


def lemma(verb: str) -> str:
    """One predicate for all forms of being and having; otherwise the verb without the s of the third person."""
    if verb in COPULAS:
        return "is"
    if verb in HAVING:
        return "has"
    if verb.endswith("ies") and len(verb) > 4:
        return verb[:-3] + "y"
    if verb.endswith(("sses", "shes", "ches", "xes", "zes")):
        return verb[:-2]
    return verb[:-1] if verb.endswith("s") and not verb.endswith("ss") and len(verb) > 3 else verb


def phrases(words: list[str], tags: list[int]) -> list[tuple[int, int, str]]:
    """Noun phrases: start, end, and the label: adjectives and nouns up to the last noun of a run, without determiners."""
    out, i, n = [], 0, len(words)
    while i < n:
        if tags[i] not in (NOUN, ADJECTIVE, DETERMINER):
            i += 1
            continue
        j = i
        while j < n and tags[j] in (NOUN, ADJECTIVE, DETERMINER) and (tags[j] != DETERMINER or j == i):
            j += 1
        end = j
        while end > i and tags[end - 1] != NOUN:
            end -= 1
        label = " ".join(w for w, t in zip(words[i:end], tags[i:end]) if t != DETERMINER)
        if label:
            out.append((i, end, label))
        i = j
    return out


def triples_of(words: list[str], tags: list[int]) -> list[tuple[str, str, str]]:
    """Subject, predicate, object: the phrase that ends before a run of verbs, its last verb, and the phrase that begins behind it or behind a preposition there."""
    found = phrases(words, tags)
    ends, starts = {e: label for _, e, label in found}, {s: label for s, _, label in found}
    out, i = [], 0
    while i < len(words):
        if tags[i] != VERB:
            i += 1
            continue
        j = i
        while j < len(words) and tags[j] == VERB:
            j += 1
        verb = words[j - 1]
        at = j + 1 if j < len(words) and tags[j] == PREPOSITION else j
        if i in ends and at in starts and (verb in COPULAS or lemma(verb) not in WEAK) and ends[i] != starts[at]:
            out.append((ends[i], lemma(verb), starts[at]))
        i = j
    return out


def _next(at: np.ndarray, stops: np.ndarray, end: int) -> np.ndarray:
    """The first stop behind each place."""
    return np.append(stops, end)[np.searchsorted(stops, at, "right")]


def _phrases(words: pa.Array, tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """`phrases` of many sentences at once; first: whether a word begins one."""
    inside = np.isin(tags, (NOUN, ADJECTIVE, DETERMINER))
    begins = inside & (first | ~np.append(False, inside[:-1]) | (tags == DETERMINER))
    start = np.flatnonzero(begins)
    end = 1 + np.maximum.accumulate(np.where(tags == NOUN, np.arange(len(tags)), -1))[_next(start, np.flatnonzero(~inside | begins), len(tags)) - 1]
    start, end = start[end > start], end[end > start]
    low = start + (tags[start] == DETERMINER)
    offsets = np.append(0, np.cumsum(end - low))
    held = words.take(pa.array(np.repeat(low - offsets[:-1], end - low) + np.arange(offsets[-1])))
    return start, end, pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held), " ")


def _triples(words: pa.Array, tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """`triples_of` many sentences at once: places of the verbs, and the three columns."""
    n = len(tags)
    start, end, label = _phrases(words, tags, first)
    ends, starts = np.full(n + 2, -1), np.full(n + 2, -1)
    ends[end], starts[start] = np.arange(len(end)), np.arange(len(start))
    verb = tags == VERB
    i = np.flatnonzero(verb & (first | ~np.append(False, verb[:-1])))
    j = _next(i, np.flatnonzero(~verb | first), n)
    over = _next(i, np.flatnonzero(first), n)
    at = j + ((j < over) & (np.append(tags, OTHER)[j] == PREPOSITION))
    subject, object_ = np.where(first[i], -1, ends[i]), np.where(at < over, starts[at], -1)
    said = words.take(pa.array(j - 1)).dictionary_encode()
    verbs = said.dictionary.to_pylist()
    told = np.array([v in COPULAS or lemma(v) not in WEAK for v in verbs], bool)[said.indices.to_numpy(zero_copy_only=False)] if verbs else np.zeros(0, bool)
    keep = np.flatnonzero((subject >= 0) & (object_ >= 0) & told)
    columns = [label.take(pa.array(subject[keep])), pa.array([lemma(v) for v in verbs], pa.string()).take(said.indices.take(pa.array(keep))), label.take(pa.array(object_[keep]))]
    other = pc.not_equal(columns[0], columns[2])
    return i[keep][other.to_numpy(zero_copy_only=False)], [c.filter(other) for c in columns]


def _extracted(tagger: Tagger, relations: bool):
    names = ["subject", "predicate", "object"] if relations else ["entity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tagger)
        for b in batches:
            codes, sizes = _numbered(b.column("words"))
            if not len(codes):
                continue
            places, active = _laid(sizes)
            tags, of = np.empty(len(codes), np.int8), np.repeat(np.arange(len(sizes)), sizes)
            tags[places] = likeliest(tagger, table, codes[places], active)
            first, words = np.append(True, np.diff(of) > 0), b.column("words").flatten()
            if relations:
                at, columns = _triples(words, tags, first)
            else:
                at, _, label = _phrases(words, tags, first)
                columns = [label]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of[at])), *columns], names=["id", *names])

    return run


def _sentences(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.explode(sentences(F.col(text))).alias("words"))


def tagged(rows: DataFrame, text: str, row_id: str, relations: bool, tagger: Tagger | None = None) -> DataFrame:
    """id and, for each one found in a whole text, subject, predicate and object, or entity. The tagger learns from the texts themselves unless given. Nulls and texts without a word have none."""
    found = _sentences(rows, text, row_id)
    tagger = tagger or learnt(found)[0]
    kind = rows.schema[row_id].dataType.simpleString()
    columns = "subject string, predicate string, object string" if relations else "entity string"
    return found.mapInArrow(_extracted(tagger, relations), f"id {kind}, {columns}")
