"""Languages, templates, fingerprint bands and label models against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import language_id, pivot_search, simhash, templates, toxicity
from scholia.llm._spark import looked_up


def bucket(gram, bits):
    h = len(gram)
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
    return (h * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - bits)


def brute_grams(text, bits):
    out, last = [], None
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        c = low if c.isalpha() else " "
        if not (c == " " and last == " "):
            out.append(c)
        last = c
    s = "".join(out)
    return [bucket(s[i : i + n], bits) for n in (1, 2, 3) for i in range(len(s) - n + 1) if n > 1 or s[i] != " "]


@pytest.mark.parametrize("most", [256, 2, 1])
def test_languages_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "MOST", most)
    rng = random.Random(3)
    words = {"en": ["the", "of", "Straße", "thing"], "fr": ["été", "le", "DES", "chose"], "ja": ["日本", "語", "の"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 9))) + rng.choice(["", "1 2", " -!"]), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(60))]
    mixed = [(100 + i, " ".join(rng.choice(sum(words.values(), [])) for _ in range(4)), None) for i in range(40)] + [(200, "12 ?", None), (201, None, None)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    model = language_id.fit(docs, "text", "lang", bits=12)
    bits = 12
    assert model.bits == bits and len(list(model.parts())) == -(-3 // most)
    counts, prior = defaultdict(Counter), Counter(lang for *_, lang in rows)
    for _, text, lang in rows:
        counts[lang].update(brute_grams(text, bits))
    logs = {k: {b: math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * (1 << bits))) for b in range(1 << bits)} for k in words}
    for r in language_id.predict(docs, "text", "doc_id", model).collect():
        text = dict((i, t) for i, t, _ in rows + mixed)[r.id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = {k: math.log(prior[k] / len(rows)) + sum(logs[k][b] for b in brute_grams(text, bits)) for k in words}
        best = max(sorted(z), key=z.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()), rel=1e-3)


def test_languages_beyond_one_part_of_the_matrix(spark, monkeypatch):
    """300 languages with words of their own: parts of 256 and of 60 predict what one whole matrix does, rows without a letter and repeated rows included."""
    rng = random.Random(8)
    rows = [(i % 1000, " ".join(f"{chr(0x4E00 + 7 * (i % 300))}{rng.choice('abcdefg')}" for _ in range(rng.randint(1, 4))), f"l{i % 300}") for i in range(1500)] + [(5000, None, None), (5001, "12", "l7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = []
    for most in (1000, 256, 60):
        monkeypatch.setattr(language_id, "MOST", most)
        model = language_id.fit(docs, "text", "lang", bits=12)
        assert model.bits == 12 and len(model.langs) == 300
        found.append(sorted((r.id, r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, "text", "doc_id", model).collect()))
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 1502 and len({x for _, x, _ in found[0]}) > 250
    assert language_id.predict(docs.limit(0), "text", "doc_id", model).count() == 0


def brute_tokens(text):
    """(canonical token, filler or None) of a text."""
    out, end, last_number = [], 0, False
    for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+(?:[.,][0-9]+)*", text or ""):
        t = m.group()
        low = re.sub("[A-Z]", lambda x: x[0].lower(), t)
        begins = not out or re.search("[.!?:\n\r]", text[end : m.start()])
        if t[0].isdigit() and t[0] < "\x80":
            out.append(("#num", low))
        elif last_number and low in templates.UNITS:
            out.append(("#unit", low))
        elif re.match("[A-ZÀ-Þ]", t) and not begins:
            out.append(("#name", low))
        else:
            out.append((low, None))
        last_number, end = out[-1][0] == "#num", m.end()
    return out


def brute_windows(tokens, size):
    for i in range(len(tokens) - size + 1):
        some = tokens[i : i + size]
        templated = 2 * sum(f is None for _, f in some) >= size
        yield i, tuple(t if templated or f is None else f for t, f in some) + (templated,), [f for _, f in some]


def brute_leaks(docs, items, coverage=0.5, run=13):
    found = set()
    for doc, text in docs:
        tokens = brute_tokens(text)
        for item, item_text in items:
            own = brute_tokens(item_text)
            size = min(len(own), templates.WINDOW)
            if not size:
                continue
            shifts = defaultdict(dict)
            theirs = list(brute_windows(tokens, size))
            for j, key, fill in brute_windows(own, size):
                for i, other, got in theirs:
                    if other == key:
                        shifts[i - j][j] = {(a, b) for a, b in zip(fill, got) if a or b}
            covered, ran = set(), False
            for windows in shifts.values():
                every = set().union(*windows.values())
                clash = {p for p in every for q in every if p != q and (p[0] == q[0] or p[1] == q[1])}
                same = {j for j, pairs in windows.items() if all(a == b for a, b in pairs)}
                covered |= same | {j for j, pairs in windows.items() if not pairs & clash}
                ran |= size <= run and any(all(j + k in same for k in range(run - size + 1)) for j in same)
            if ran or (covered and len(covered) / (len(own) - size + 1) >= coverage):
                found.add((doc, item))
    return found


def test_templates_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["train", "leaves", "Paris", "Anna", "240", "3.5", "km", "h", "the", "and", "Élan", "waits", "1,000", "rest"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ". ", ", ", "\n"]) for _ in range(n))
    items = [(i, make(rng.choice([2, 5, 9, 14, 25]))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        text = make(rng.randint(0, 20)) + (rng.choice(items[:30])[1] if i % 2 else "") + make(rng.randint(0, 5))
        if i % 3 == 0:
            for a, b in (("Paris", "Rome"), ("240", "17"), ("Anna", "Bo" if i % 4 else "Rome")):
                text = text.replace(a, b)
        docs.append((i, text))
    got = {(r.id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id", spark.createDataFrame(items, "item_id long, text string"), "text", "item_id").collect()}
    want = brute_leaks(docs, items)
    assert got == want and 40 < len(want) < 2000


@pytest.mark.parametrize("n", [10, 10**8, 10**10])
def test_wider_bands_find_the_same_groups(spark, n):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = {int(x) for x in base}
    for x in base[:40]:
        for _ in range(3):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    root = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    assert simhash.agreeing(4, n) == {10: 2, 10**8: 3, 10**10: 4}[n]
    got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df, n=n)).collect()}
    groups = defaultdict(set)
    for x in fps:
        groups[got.get(x, x)].add(root[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))


def test_lookup_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr("scholia.llm._spark.FREQUENT", 5)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(50)], "id int, k int")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10).where("k <> 4")
    got = {(r.id, r.v) for r in looked_up(rows, table, "k", "n").collect()}
    assert got == {(i, 0 if i % 2 else i * 10) for i in range(50) if i != 4}


def test_large_components_meet_in_whole_numbers(spark):
    """Vectors whose scores may pass a long stand beside ordinary ones, as queries and as candidates."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [rng.choice([1e9, -3e12, 2e15]) * rng.random(), 1.0, rng.gauss(0, 1)]) for i in range(12)] + [(250, [4e14, -2.0, 1e3]), (300, [1e300, 0.0, 0.0]), (301, [1e308, 0.0, 0.0]), (302, [5e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in pivot_search.top(df, "embedding", "vec_id", F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if all(math.isfinite(256 * x) for x in v)}
    for q in (0, 50, 100, 200, 250, 300):
        scored = [(-min((1 << 63) - 1, max(-(1 << 63), sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:5])], q
    assert set(got) == {0, 50, 100, 200, 250, 300}


def brute_posteriors(patterns, counts, prior, rounds=60):
    """Expectation maximisation over single votes, in loops."""
    m = 2 * toxicity.VOTERS
    votes = [[(p >> v) & 1 for v in range(m)] + [int(p == 0)] for p in patterns]
    share, post = [1.0] * (m + 1), [0.02 if p == 0 else 0.9 for p in patterns]
    for again in (0, 1):
        for _ in range(rounds):
            w1 = [c * q for c, q in zip(counts, post)]
            w0 = [c * (1 - q) for c, q in zip(counts, post)]
            p1 = [(sum(w * x[v] for w, x in zip(w1, votes)) + 0.5) / (sum(w1) + 1) for v in range(m + 1)]
            p0 = [(sum(w * x[v] for w, x in zip(w0, votes)) + 0.5) / (sum(w0) + 1) for v in range(m + 1)]
            pi = min(1 - 1e-4, max(1e-4, (sum(w1) + prior) / (sum(counts) + 1)))
            post = []
            for x in votes:
                z = math.log(pi / (1 - pi)) + sum(share[v] * (math.log(p1[v] / p0[v]) if x[v] else math.log((1 - p1[v]) / (1 - p0[v]))) for v in range(m + 1))
                post.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        if not again:
            tied = [[0.0] * (m + 1) for _ in range(m + 1)]
            for w in ([c * q for c, q in zip(counts, post)], [c * (1 - q) for c, q in zip(counts, post)]):
                total = sum(w)
                p = [(sum(a * x[v] for a, x in zip(w, votes)) + 0.5) / (total + 1) for v in range(m + 1)]
                sd = [math.sqrt(x * (1 - x)) + 1e-9 for x in p]
                for u in range(m + 1):
                    for v in range(m + 1):
                        if u != v:
                            joint = sum(a * x[u] * x[v] for a, x in zip(w, votes)) / max(total, 1e-9)
                            tied[u][v] = max(tied[u][v], min(1.0, max(0.0, (joint - p[u] * p[v]) / (sd[u] * sd[v]))))
            share = [1 / (1 + sum(tied[v])) for v in range(m + 1)]
    return post


def test_label_model_against_loops():
    rng = random.Random(8)
    patterns = sorted({0, *(rng.randrange(1 << (2 * toxicity.VOTERS)) & rng.randrange(1 << (2 * toxicity.VOTERS)) for _ in range(25))})
    counts = [rng.randint(1, 60) if p else 900 for p in patterns]
    got = toxicity.label_model(np.array(patterns), np.array(counts, float), 0.1)
    assert got.tolist() == pytest.approx(brute_posteriors(patterns, counts, 0.1), abs=1e-6)
    assert got[0] < 0.1 and got.max() > 0.5
