"""URL rules, decontamination, near duplicates, search and personal data against brute force; the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import personal_data, piece_codec, pivot_search, queries, simhash, templates, url_rules
from test_near_copies import brute_groups


def test_url_rules(spark):
    urls = [None, "", "x", "http://", "https://A.Example.ORG/en/1x?q", "http://example.org/en/2", "http://notexample.org/es/", "http://example.org/es/", "ftp://example.com#f", "http://c.com/fr/a", "http://c.com/de/", "http://c.com/de", "http://a.org", "http://user@h.org:80/", "x://y://org/", "http://.org/", "http://b..org/", "http://c.com/de/"]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, short int")
    got = {r.page_id: r for r in url_rules.judged(pages, "url", spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2])
    # most rows are of few sites, and columns have the names of the operator's own
    many = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'http://c.com/de/x' ELSE concat('http://h', id, '.org/es/') END AS url", "id AS site", "id AS times", "id AS best", "id AS short")
    got = {(r.page_id % 3, r.rule, r.verdict, r.site == r.page_id) for r in url_rules.judged(many, "url", spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {(0, None, "allow", True), (1, "com/de/", "block", True), (2, "org/", "allow", True)}
    none = url_rules.judged(pages, "url", spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_rules.judged(pages.limit(0), "url", spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


ITEM = "A train leaves Paris with Anna on board and covers 240 km in 3 hours before it stops near Lyon where Bruno waits for 15 min"


def test_templates(spark, hard, empty):
    items = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (4, "")], "item_id int, text string")
    same = "Some words before this one. " + ITEM.replace("Paris", "Rome").replace("Anna", "Carla").replace("240", "300").replace(" 3 ", " 4 ").replace("15", "20") + " and more after it"
    # the same shape, with fillers that clash all over
    clash = ITEM.replace("Paris", "Rome").replace("Anna", "Rome").replace("240", "7").replace(" 3 ", " 7 ").replace("Lyon", "Rome").replace("Bruno", "Rome").replace("15", "7")
    docs = spark.createDataFrame([(1, "x " + ITEM + " y"), (2, same), (3, "nothing of the kind stands in this text"), (4, "here is a tiny item again"), (5, None), (6, ""), (7, clash), (None, ITEM), (8, "half " + " ".join(ITEM.split()[:9]))], "doc_id long, text string")
    got = {(r.id, r.item_id) for r in templates.leaks(docs, "text", "doc_id", items, "text", "item_id").collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
    left = templates.clean(docs, "text", "doc_id", items, "text", "item_id").collect()
    assert {r.doc_id for r in left} == {3, 5, 6, 7, 8, None}
    assert templates.leaks(hard, "text", "doc_id", items, "text", "item_id").count() == 0
    assert templates.leaks(empty, "text", "doc_id", items, "text", "item_id").count() == 0
    assert templates.clean(hard, "text", "doc_id", items.limit(0), "text", "item_id").count() == hard.count()


def test_verbatim_parts_of_items_are_leaks(spark):
    """One changed number, names changed in one place only, and long verbatim runs; short runs are none."""
    item = "A farmer in Kent stores 12 crates of pears and 12 crates of plums in a cold barn near the river until Martha comes with a small van and takes every second crate of the pears to the market in town and sells them there before noon"
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    words = item.split()
    texts = [item, item.replace("12 crates of plums", "15 crates of plums"), item.replace("12 crates of pears", "9 crates of pears").replace("12 crates of plums", "15 crates of plums")]
    texts += ["Elsewhere it says " + " ".join(words[20:38]) + " and so on", "Elsewhere it says " + " ".join(words[20:33]) + " and so on", "Elsewhere it says " + " ".join(words[20:31]) + " and so on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id for r in templates.leaks(docs, "text", "doc_id", items, "text", "item_id").collect()} == {0, 1, 2, 3, 4}


def brute_fingerprint(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(fps, distance=4):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark, hard, empty):
    rows = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    want = brute_components(fps)
    groups = simhash.grouped(hard, "text", "doc_id")
    got = {r.id: (r.fp % (1 << 64), r.component) for r in groups.collect() if r.id is not None}
    assert got == {i: (fps[i], want[i]) for i in rows}
    assert groups.count() == hard.count()
    kept = simhash.kept(hard, "text", "doc_id")
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert simhash.grouped(empty, "text", "doc_id").count() == 0 and simhash.kept(empty, "text", "doc_id").count() == 0


def test_links_find_every_near_pair(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    fps = [int(x) for x in base]
    for x in base[:60]:  # near ones at 1 to 6 bits, and a crowd around one
        y = int(x)
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            y ^= 1 << int(b)
        fps.append(y)
    for _ in range(150):
        y = int(base[0])
        for b in rng.choice(64, 2, replace=False):
            y ^= 1 << int(b)
        fps.append(y)
    fps = sorted(set(fps))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    of = {r.node % (1 << 64): r.root for r in roots}
    want = brute_components(dict(enumerate(fps)))
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(of.get(x, x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (103, 100), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 16)).round(2)
    vectors[100:260] = vectors[100]  # a crowd of equal vectors
    rows = [(i, [float(x) for x in v], "z", 1) for i, v in enumerate(vectors)]
    rows += [(700, None, "z", 1), (750, [1.0, None] * 8, "z", 1), (800, [float("nan")] * 16, "z", 1), (850, [float("inf")] * 16, "z", 1), (None, [1.0] * 16, "z", 1), (900, [1.0, 2.0], "z", 1), (950, [2.0, 2.0], "z", 1), (3, rows[3][1], "z", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, pivot string, block int")
    got = sorted(map(tuple, pivot_search.top(df, "embedding", "vec_id", F.col("vec_id") % 50 == 0, 5, pivots=8).collect()))
    whole = np.floor(256 * vectors.astype(np.float32).astype(np.float64)).astype(int)
    want = [(900, 1, 950, 512 * 256 + 512 * 512), (950, 1, 900, 512 * 256 + 512 * 512)]
    for q in range(0, 700, 50):
        s = whole @ whole[q]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != q][:5]
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)
    assert pivot_search.top(df.limit(0), "embedding", "vec_id", F.col("vec_id") % 50 == 0, 5).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    spans = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_personal_data_against_brute_force(spark, hard, empty):
    rng = random.Random(6)
    letters = "0123456789" * 3 + "..--  ++()@@abc_%é日\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "a@b.c.", "x 4111 1111-1111 1111 y", "4111111111111111 4111", "1.2.3.4.5.6.7.8", "001.02.3.255 1.2.3.256 1.2.3.00000000000000000001", "+1 (555) 010-9999.", "a@b." + "c." * 5000 + "d", "1" * 50000, "1-" * 20000 + "1", "a" * 60000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = personal_data.found(docs, "text", "doc_id")
    got = {r.id: r for r in spans.select("id", personal_data._joined("base").alias("base"), personal_data._joined("concat(base, added)").alias("all")).collect()}
    wrong = [(t, got[i].base, brute_spans(t)) for i, t in enumerate(texts) if got[i].base != brute_spans(t)]
    assert not wrong, [w[0][:80] if w[0] else w for w in wrong[:5]]
    assert all(set(filter(None, r.base.split(","))) <= set(r["all"].split(",")) for r in got.values())
    assert personal_data.found(hard, "text", "doc_id").count() == hard.count()
    assert personal_data.found(empty, "text", "doc_id").count() == 0
    masked = personal_data.masked(hard, "text", "doc_id")
    assert masked.columns == hard.columns and masked.count() == hard.count()


def test_personal_data_in_long_texts_and_clashing_columns(spark):
    """Time in proportion to the length, whatever the number of matches; contexts of any length; columns of any name."""
    def seconds(n):
        docs = spark.createDataFrame([(1, "a1 " * n)], "doc_id long, text string")
        start = time.time()
        assert personal_data.found(docs, "text", "doc_id").selectExpr("size(base) + size(added) AS n").first().n == 0
        return time.time() - start

    seconds(10)
    seconds(350_000)  # one megabyte
    once, twice = seconds(350_000), seconds(700_000)
    assert once < 60 and twice < 3.5 * once
    many = " ".join(f"x{i}@mail.example +1 555 010 {1000 + i}" for i in range(20_000))
    long_word = "w" * 400
    rows = [(i, f"{long_word}{long_word} {long_word} user{i}@example.com", "r") for i in range(12)] + [(50, f"{long_word}{long_word} {long_word} joe(at)example99", "r"), (60, many, "r"), (None, "mail a@b.cd", "r"), (70, None, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "row AS __row", "row AS __id", "row AS __spans", "row AS doc", "row AS spans", "row AS cut", "row AS id", "row AS part", "row AS words")
    masked = personal_data.masked(docs, "text", "doc_id")
    assert masked.columns == docs.columns
    got = {r.doc_id: r for r in masked.collect()}
    assert got[50].text == f"{long_word}{long_word} {long_word} <email>" and got[50].spans == "r" and got[50]["__row"] == "r"
    assert got[60].text == " ".join(["<email> <phone>"] * 20_000) and got[None].text == "mail <email>" and got[70].text is None
    wide = "日本" * 1500 + " é@ü a@b.cd " + "x" * 999 + " 10.0.0.1 b@c.de"
    out = personal_data.masked(spark.createDataFrame([(1, wide)], "doc_id long, text string"), "text", "doc_id").first().text
    assert out == "日本" * 1500 + " é@ü <email> " + "x" * 999 + " <ip> <email>"


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please send all mail to user{i}@example.com for help") for i in range(12)]
    rows += [(100, "please send all mail to joe(at)example99 for help"), (101, "version 99 of the thing"), (102, "clean words only")]
    got = {r.id: [(x.kind, x.surface) for x in r.added] for r in personal_data.found(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").collect()}
    assert got[100] == [("email", "joe(at)example99")] and not any(v for k, v in got.items() if k != 100)
    masked = {r.doc_id: r.text for r in personal_data.masked(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").collect()}
    assert masked[100] == "please send all mail to <email> for help" and masked[3] == "please send all mail to <email> for help" and masked[101] == rows[13][1]


def test_bootstrapping_goes_on_from_found_identifiers(spark):
    first = "please send all mail to {} for help"
    second = "archive copies always reach {} after lunch today"
    third = "old people still prefer {} over anything else"
    rows = [first.format(f"user{i}@example.com") for i in range(40)]
    hop = [f"joe{i}(at)example" for i in range(12)]
    far = [f"ann{i}(at)sample" for i in range(12)]
    rows += [first.format(x) for x in hop] + [second.format(x) for x in hop]  # second: no base seed at all
    rows += [second.format(far[0]), third.format("eve7(at)sample"), "version 99 of the thing"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = lambda **kw: {x.surface for r in personal_data.found(docs, "text", "doc_id", share=0.6, **kw).collect() for x in r.added}
    assert found(rounds=1) == set(hop)
    assert found() == {*hop, far[0]}


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        texts = {r.doc_id: r.text for r in docs.collect()}
        left = {r.doc_id: r.text for r in after.collect()}
        if name == "near-duplicates":
            assert set(left) == set(brute_groups(texts).values())
        elif name == "decontamination":
            norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
            items = [norm(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert set(left) == {i for i, t in texts.items() if not any(x in norm(t) for x in items)}
        elif name == "personal-data":
            assert set(left) == set(texts) and not any(brute_spans(t) for t in left.values())
            assert all(left[i] == t for i, t in texts.items() if not brute_spans(t))
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len(last) == docs.count() and all(r.exact for r in last)
    assert corpus_pipeline.run(spark, d).count() == len(last)


def test_pipeline_batches_of_long_texts_are_bounded(spark, monkeypatch):
    """Workers get a few MB of texts at once, not 10,000 rows however long; a longer text goes alone, and none is lost."""

    def sizes(path, most):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([[]] * n, pa.list_(pa.int32())), pa.array([b.nbytes] * n), pa.array([True] * n)], names=["id", "ids", "n_tokens", "exact"])

        return run

    monkeypatch.setattr(piece_codec, "_encoded", sizes)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(F.col("id") == 7, 1_000_000).otherwise(2000).cast("int")).alias("text"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert len(got) == 2000
    assert max(n for i, n in got.items() if i != 7) < 8 << 20  # the batch of the long text has others before it


def test_queries_have_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "op1_context_tree": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op3_url_rules": {"page_id", "host", "path", "rule", "verdict"},
        "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op7_simhash": {"doc_id", "fingerprint", "component_id"}, "op8_pivot_search": {"query_id", "rank", "vec_id", "score"}, "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op10_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    }
    for name, columns in want.items():
        assert columns <= set(queries.QUERIES[name](spark, d).columns)
    none = queries.QUERIES["op10_personal_data"](spark, d).where("spans = ''").first()
    assert none.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pipeline_on_hard_and_empty_tables(spark, hard, empty):
    """Every stage on nulls, empty and long texts, ties, repeated rows, no rows, and columns of any name."""
    d = "/root/testdata/sf0.001"
    names = ["__id", "__row", "__leak", "__times", "spans", "text_", "key", "class"]
    for table in (hard, empty):
        wide = table.selectExpr("*", *(f"row AS `{n}`" for n in names))
        docs = wide
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == wide.columns and docs.count() <= wide.count()
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, d)
        assert encoded.count() == docs.count()
        assert table is empty or {None, 43, 44} <= {r.doc_id for r in docs.select("doc_id").collect()}
