"""Near copies against all pairs of shingle sets."""

import random
import re

import corpus_pipeline
import pyarrow as pa
from scholia.llm import _text as T
from scholia.llm import near_copies, simhash


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(texts, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            union = len(sets[a] | sets[b])
            if a < b and (not union or 5 * len(sets[a] & sets[b]) >= 5 * similarity * union - 1e-9):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_every_near_copy_is_found(spark, hard, empty):
    rng = random.Random(11)
    texts = {}
    for i in range(0, 400, 4):  # near ones at similarities around 0.8, and chains of edits
        t = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 300)))
        texts |= {i: t, i + 1: edited(rng, t, max(1, len(t.split()) // 50)), i + 2: edited(rng, t, max(1, len(t.split()) // 35)), i + 3: t.upper()}
    for i in range(400, 520):  # a crowd around one text
        texts[i] = edited(rng, texts[0], 1)
    got = {r.id: r.component for r in near_copies.grouped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "text", "doc_id").collect()}
    want = brute_groups(texts)
    assert got == want and 100 < len(set(want.values())) < 250
    rows = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    kept = corpus_pipeline.drop_copies(spark, hard, "")
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(brute_groups(rows).values()))
    assert near_copies.grouped(empty, "text", "doc_id").count() == 0 and near_copies.kept(empty, "text", "doc_id").count() == 0


def test_boilerplate_of_unlike_texts_links_none(spark):
    """Boilerplate that unlike texts share, with near copies among them."""
    rng = random.Random(5)
    shared = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(0, 240, 3):
        own = [f"o{rng.randrange(400)}" for _ in range(rng.choice((30, 45, 60)))]
        t = " ".join(shared + own)
        texts |= {i: t, i + 1: edited(rng, t, 1), i + 2: " ".join(own + shared)}
    for i in range(240, 300):
        texts[i] = edited(rng, texts[0], 1)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_groups(texts)
    assert 20 < len(set(want.values())) < 240
    assert {r.id: r.component for r in near_copies.grouped(rows, "text", "doc_id").collect()} == want


def test_fingerprints_find_near_copies_first(spark, monkeypatch):
    """Without the MinHash bands, copies whose fingerprints are within 4 bits are still found, and only those that are similar enough."""
    rng = random.Random(3)
    texts = {}
    for i in range(0, 300, 3):
        t = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
        texts |= {i: t, i + 1: edited(rng, t, 1), i + 2: edited(rng, t, 40)}
    for i in range(300, 500):  # more links of one text than are verified together
        texts[i] = edited(rng, texts[0], 1)
    texts |= {500: "a b c d e " * 30, 501: "a b c d e " * 31, 502: texts[6] + " " + " ".join([texts[6]] * 3)}
    print_of = {i: int(simhash.fingerprints(*T.buffers(pa.array([t])), 5)[0, 0]) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (print_of[a] ^ print_of[b]).bit_count() <= 4 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}

    def no_bands(batches):
        for _ in batches:
            pass
        yield from ()

    monkeypatch.setattr(near_copies, "_bucketed", no_bands)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, rows, "").collect()}
    assert len(texts) - len(set(root.values())) > 250
    assert kept == set(root.values())
