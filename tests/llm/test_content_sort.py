import hashlib
import re
from collections import defaultdict

from scholia.llm import content_sort


def brute(rows):
    """Sorted (id, keep_id, group_size, kept, digest) of (id, text) rows."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for norm, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_equals_brute_force(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    assert got(content_sort.grouped(hard, "text", "doc_id")) == brute(rows)


def test_blanks_and_edges(spark):
    texts = ["a b", "a  b", "a\t\nb", " a b", "a b ", "", None, " ", "\n\n", "a b", "a b", "A b", "x" * 100 + "1", "x" * 100 + "2"]
    rows = [(n * 3 % 17, t) for n, t in enumerate(texts)] + [(None, "a b"), (None, "only nulls"), (None, "only nulls"), (0, "a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert got(content_sort.grouped(df, "text", "id")) == brute(rows)


def test_frequent_texts_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "FREQUENT", 8)  # frequent from an eighth of the rows on
    rows = [(n, "hot text" if n % 2 else f"text {n}") for n in range(200)] + [(None, "hot text")] * 3 + [(7, "hot text")] * 2
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    assert got(content_sort.grouped(df, "text", "id")) == brute(rows)


def test_nothing_but_nulls_in_a_frequent_text(spark):
    rows = [(None, "same")] * 20
    assert got(content_sort.grouped(spark.createDataFrame(rows, "id long, text string"), "text", "id")) == brute(rows)


def test_empty(spark, empty):
    assert got(content_sort.grouped(empty, "text", "doc_id")) == []
    assert content_sort.kept(empty, "text", "doc_id").count() == 0


def test_plan_has_no_python(spark, hard, capsys):
    content_sort.grouped(hard, "text", "doc_id").explain()
    assert "Python" not in capsys.readouterr().out
