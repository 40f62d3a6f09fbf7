"""Context-tree scores against a plain tree, languages, toxicity, token counts and ids."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scholia.llm import context_tree, language_id, piece_codec, pieces, token_counts, toxicity
from scholia.llm import _text as T
from scholia.llm._spark import fold

DEPTH = 3


def brute_scores(rows, depth):
    """Scores by a dictionary of nodes (bit prefix, context) and recursion."""
    def steps(text):
        data = text.encode()
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data) + b"\xff"
        padded = b"\xff" * depth + data
        for i, y in enumerate(data):
            context = padded[i : i + depth][::-1]  # nearest byte first
            for bit in range(8):
                yield (bit, y >> (8 - bit)), context, (y >> (7 - bit)) & 1

    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text, training in rows:
        for prefix, context, value in steps(text):
            for d in range(depth + 1):
                if training:
                    counts[prefix, context[:d]][value] += 1
                if d:
                    children[prefix, context[: d - 1]].add(context[:d])

    def own(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(prefix, context):
        if (prefix, context) not in memo:
            e = own((prefix, context))
            if len(context) < depth:
                below = sum(weighted(prefix, c) for c in children[prefix, context])
                e = max(e, below) + math.log1p(math.exp(-abs(e - below))) - math.log(2)
            memo[prefix, context] = e
        return memo[prefix, context]

    out = []
    for text, _ in rows:
        total = 0.0
        for prefix, context, value in steps(text):
            p = None
            for d in range(depth, -1, -1):
                node = prefix, context[:d]
                a, b = counts[node]
                kt = ((b if value else a) + 0.5) / (a + b + 1)
                stop = 1.0 if d == depth else math.exp(own(node) - math.log(2) - weighted(*node))
                p = kt if p is None else stop * kt + (1 - stop) * p
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_context_tree_against_brute_force(spark, most):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["The", "then", "théâtre", "of", "ofthe"]) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 != 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, training boolean")
    model = context_tree.fit(docs, "text", F.col("training"), depth=DEPTH)
    got = {r.id: r for r in context_tree.score(docs, "text", "doc_id", model, covered=True, most_broadcast=most).collect()}
    want = brute_scores([(t, training) for _, t, training in rows], DEPTH)
    low = [[w.lower() for w in t.split()] for t in texts]
    counts = Counter(w for (_, _, training), ws in zip(rows, low) if training for w in ws)
    n_train = sum(t for _, _, t in rows)
    n, v = sum(counts.values()) + n_train, len(counts) + 1
    p = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert model.tokens == n
    for i, ws in enumerate(low):
        assert got[i].total == pytest.approx(want[i], abs=1e-4)
        assert got[i].base == pytest.approx(sum(p(counts[w]) for w in ws) + p(n_train), abs=1e-6)
        assert (got[i].words, got[i].known) == (len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1)


@pytest.mark.parametrize("most", [10**6, 0])
def test_texts_that_were_not_fitted(spark, most):
    """Grams and contexts that training never met have their tree's probability, one by broadcast and by join."""
    fitted = [(i, "the then of théâtre " * (i + 1), True) for i in range(6)]
    others = [(10, "zzqxv jjkkw qqqq", False), (11, "the then zz", False), (12, "", False), (13, None, False), (14, "日本", False)]
    model = context_tree.fit(spark.createDataFrame(fitted, "doc_id long, text string, training boolean"), "text", F.col("training"), depth=DEPTH)
    docs = spark.createDataFrame(others, "doc_id long, text string, training boolean")
    got = {r.id: r.total for r in context_tree.score(docs, "text", "doc_id", model, most_broadcast=most).collect()}
    want = brute_scores([(t or "", training) for _, t, training in fitted + others], DEPTH)[len(fitted):]
    assert [got[i] for i, _, _ in others] == pytest.approx(want, abs=1e-4) and got[10] < -20
    with pytest.raises(Exception, match="covered=False"):
        context_tree.score(docs, "text", "doc_id", model, covered=True, most_broadcast=10**6).collect()


def test_subtrees_in_runs(spark, monkeypatch):
    """Runs of whole subtrees give what one run gives."""
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 32, 3000).astype(np.uint64) >> np.uint64(7) << np.uint64(3))
    counts = rng.integers(0, 5, len(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100].view(np.int64)), pa.array(counts[i : i + 100])], names=["key", "n"]) for i in range(0, len(keys), 100)]
    whole = context_tree.summaries(keys, counts, 3, 2)
    monkeypatch.setattr(context_tree, "RUN_GRAMS", 250)
    runs = list(context_tree._subtrees(iter(batches), 16))
    assert len(runs) > 5 and np.array_equal(np.concatenate([k for k, _ in runs]), keys)
    parts = [context_tree.summaries(k, c, 3, 2) for k, c in runs]
    for bit in range(8):
        want = dict(zip(whole[bit][0].tolist(), whole[bit][3].tolist()))
        got = {k: v for p in parts for k, v in zip(p[bit][0].tolist(), p[bit][3].tolist())}
        assert got == pytest.approx(want)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 400).astype(np.uint8)
    keys, _ = context_tree.grams(data, np.array([0, 400]), DEPTH)
    contexts = np.unique(keys >> np.uint64(8))
    grid = ((contexts[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None, :]).ravel()
    seen, n = np.unique(keys, return_counts=True)
    counts = np.zeros(len(grid), np.int64)
    counts[np.searchsorted(grid, seen)] = n
    above = context_tree.roots(context_tree.summaries(grid, counts, DEPTH, 2), 2)
    p = 10 ** context_tree.log10_probabilities(grid, counts, DEPTH, 2, above).reshape(-1, 256)
    assert np.allclose(p.sum(axis=1), 1)


@pytest.mark.parametrize("name", ["hard", "empty"])
def test_hard_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    n = docs.count()
    model = context_tree.fit(docs, "text", fold("doc_id", 10) != 0, depth=2)
    scored = context_tree.score(docs, "text", "doc_id", model).collect()
    assert len(scored) == n and all(math.isfinite(r.total) and math.isfinite(r.base) for r in scored)
    lang = language_id.fit(docs, "text", "lang")
    found = language_id.predict(docs, "text", "doc_id", lang).collect()
    assert len(found) == n and all(0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == "und" for r in found if r.id in (40, 41, 42))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxic = toxicity.score(docs, "text", "doc_id", toxicity.fit(docs, "text", "doc_id", labels, "toxic")).collect()
    assert len(toxic) == n and all(0 <= r.score <= 1 for r in toxic)
    counted = token_counts.counts(docs, "text", "doc_id").collect()
    encoded = piece_codec.encode(docs, "text", "doc_id")
    assert sorted((r.id is None, r.id or 0, r.n_tokens) for r in counted) == sorted((r.id is None, r.id or 0, r.n_tokens) for r in encoded.collect())
    assert all(r.exact for r in encoded.collect())
    assert sorted(r.text for r in piece_codec.decode(encoded, "ids", "id").collect()) == sorted((r.text or "") for r in docs.collect())


def test_pieces_against_library():
    path = pieces.default_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = ' \n\ta be theiongr▁é日😀ｆ.,0\x00\r;)"ABC'
    texts = ["", " ", "hello  world", "<s>x</s>", "a" * 3000, "the" * 900, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)), *("a" + " " * k + x for k in range(60) for x in ("", "b", "日", "\n"))]
    want = library.encode(texts)
    w = pieces.words(path)
    data, offsets = T.buffers(pieces.plain(pa.array(texts)))
    ids, at = w.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert token_counts.counter(path).count(data, offsets).tolist() == [len(x) for x in want]
    back, bounds = w.decode(ids, at)
    assert [back[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])] == [t.replace("▁", " ") for t in texts]


def test_stream_commits_early():
    a = pieces.words(pieces.default_path()).a
    stream, word = pieces.Stream(a), "▁" + "internationalisation" * 200
    out, widest = [], 0
    for i in range(0, len(word), 16):
        out += stream.push(word[i : i + 16])
        widest = max(widest, len(stream.lasts))
    out += stream.end()
    assert out == a.encode(word) and widest < 200


@pytest.mark.parametrize(("chunk", "window"), [(128, 1 << 19), (16, 1000), (3, 50), (1, 7)])
def test_chunks_compose(chunk, window):
    """Counts of the library whatever the cuts into chunks and windows, on texts with and without bounds."""
    path = pieces.default_path()
    rng = random.Random(12)
    kana = "".join(chr(rng.randrange(0x3040, 0x30FF)) for _ in range(700))
    texts = ["The quick brown foxes  jumped over\nthe lazy dogs, again and again. " * 5, "", "a" * 900, "the" * 300, "internationalisation" * 60, kana, "日本語" * 300, "".join(rng.choice("abcdeinort") for _ in range(2000)), " " * 77, "x" + " " * 50 + "y", "".join(rng.choice(" \nae日é▁0") for _ in range(1500))]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    data, offsets = T.buffers(pieces.plain(pa.array(texts)))
    counter = token_counts.Counter(pieces.Automaton(pieces.Vocabulary(path)), chunk, window)
    assert counter.count(data, offsets).tolist() == want
    assert counter.count(data, offsets).tolist() == want


def test_prefix_scan_of_state_maps():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 7, 1, 64, 33]
    depth = np.concatenate([np.arange(n) for n in sizes])
    to, n = rng.integers(0, 3, (len(depth), 3)), rng.integers(0, 9, (len(depth), 3))
    want_to, want_n = to.copy(), n.copy()
    for i in range(len(depth)):
        if depth[i]:
            want_n[i] = want_n[i - 1] + n[i][want_to[i - 1]]
            want_to[i] = to[i][want_to[i - 1]]
    got_to, got_n = token_counts.scanned(to.copy(), n.copy(), depth)
    assert np.array_equal(got_to, want_to) and np.array_equal(got_n, want_n)


def test_kept_transitions_and_counts_are_bounded(monkeypatch):
    path = pieces.default_path()
    rng = random.Random(3)
    monkeypatch.setattr(pieces, "MOST_STATES", 300)
    monkeypatch.setattr(token_counts, "MOST_COUNTS", 200)
    texts = ["".join(rng.choice("abcdefghijk 日本") for _ in range(300)) for _ in range(60)]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    counter = token_counts.Counter(pieces.Automaton(pieces.Vocabulary(path)), 16, 600)
    data, offsets = T.buffers(pa.array(texts))
    assert counter.count(data, offsets).tolist() == want and len(counter.a.states) < 1500 and len(counter.known) < 800
    kana = "".join(chr(rng.randrange(0x3040, 0x30FF)) for _ in range(20_000))
    a = pieces.Automaton(pieces.Vocabulary(path))
    assert a.encode("▁" + kana) == sentencepiece.SentencePieceProcessor(model_file=path).encode(kana) and len(a.states) < 500


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.where(fold("doc_id", 5) != 0), "text", "lang")
    held = language_id.predict(docs.where(fold("doc_id", 5) == 0), "text", "doc_id", model)
    wrong = held.join(docs, held.id == docs.doc_id).where("lang != lang_pred").count()
    assert wrong == 0


def test_toxicity_held_out(spark):
    """Planted insults in two languages, one by inflected beginnings only; some labels are wrong."""
    rng = random.Random(9)
    syllables = ["ka", "lo", "mi", "ren", "tus", "vol", "sha", "pir"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(3000):
        words, toxic = [word() for _ in range(rng.randint(5, 80))], i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["dolt", "knave", "Oaf,"]) if i % 16 else "zwerg" + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic != (rng.random() < 0.02))))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    learning = fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learning), "text", "doc_id", marks.where(learning), "toxic")
    held = toxicity.score(docs.where(~learning), "text", "doc_id", model).collect()
    assert np.mean([r.score >= 0.5 for r in held if r.id % 8 == 0]) > 0.97
    assert np.mean([r.score >= 0.5 for r in held if r.id % 8]) < 0.01
    clean = toxicity.clean(docs, "text", model)
    assert clean.columns == docs.columns and clean.where("doc_id % 8 = 0").count() < 15 and clean.where("doc_id % 8 <> 0").count() > 2600


def test_broadcast_and_join_agree(spark):
    """Probabilities are doubles on both ways: no score depends on the size of the learnt table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = context_tree.fit(docs, "text", F.col("doc_id") % 10 != 0)
    ways = [{r.id: r.total for r in context_tree.score(docs, "text", "doc_id", model, covered=True, most_broadcast=most).collect()} for most in (10**8, 0)]
    assert len(ways[0]) == docs.count()
    assert ways[0] == pytest.approx(ways[1], rel=1e-12, abs=1e-9)


def test_work_per_word_does_not_grow_by_calls_per_piece():
    """Following the back pointers of a word whose moves are known makes no call a piece."""
    a = pieces.Automaton(pieces.Vocabulary(pieces.default_path()))

    def calls(word):
        a.encode(word)
        n = [0]

        def count(frame, event, arg):
            n[0] += event == "call"

        sys.setprofile(count)
        try:
            ids = a.encode(word)
        finally:
            sys.setprofile(None)
        return n[0], len(ids)

    (few, short), (many, long) = calls("\u2581the"), calls("\u2581xqzkvjwpqxzjkvqwzxkj")
    assert long > short + 5 and many == few
