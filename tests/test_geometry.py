import random

import numpy as np
import pytest

from scholia.operators import geometry

SCHEMA = "page long, x0 double, y0 double, x1 double, y1 double, text string"


def column(x, y, n, width=200, step=14, prefix=""):
    return [(x, y + step * i, x + width, y + step * i + 10, f"{prefix}{i}") for i in range(n)]


def read(spark, pages):
    rows = [(p, *map(float, s[:4]), s[4]) for p, spans in pages.items() for s in spans]
    random.Random(1).shuffle(rows)
    found = geometry.blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("page", "place").collect()
    out = {}
    for r in found:
        out.setdefault(r.page, []).append((r.kind, r.text))
    return out


def test_layouts_in_reading_order(spark):
    two = [(40, 40, 540, 56, "A wide title over both"), *column(40, 100, 5, prefix="l"), *column(340, 100, 4, prefix="r"), (40, 300, 540, 310, "foot note below all")]
    gapped = column(40, 100, 3, prefix="a") + column(40, 170, 3, prefix="b") + column(340, 100, 3, prefix="c") + column(340, 170, 3, prefix="d")  # gaps at one height in both columns
    table = [(40 + 120 * c, 100 + 20 * r, 70 + 120 * c, 110 + 20 * r, f"{r}{c}") for r in range(3) for c in range(4) if (r, c) != (1, 2)]
    pairs = [(40 + 200 * c, 100 + 20 * r, 90 + 200 * c, 110 + 20 * r, f"{r}{c}") for r in range(4) for c in range(2)]
    words = [(40 + 30 * i, 100 + 12 * j, 66 + 30 * i, 110 + 12 * j, f"w{j}{i}") for j in range(2) for i in range(3)]
    got = read(spark, {1: two, 2: gapped, 3: table, 4: pairs, 5: words, 6: [(0, 0, 10, 10, "Title")]})
    assert got[1] == [("paragraph", "A wide title over both"), ("paragraph", "l0\nl1\nl2\nl3\nl4"), ("paragraph", "r0\nr1\nr2\nr3"), ("paragraph", "foot note below all")]
    assert [t for _, t in got[2]] == ["a0\na1\na2", "b0\nb1\nb2", "c0\nc1\nc2", "d0\nd1\nd2"]
    assert got[3] == [("row", "00 | 01 | 02 | 03"), ("row", "10 | 11 | 13"), ("row", "20 | 21 | 22 | 23")]
    assert got[4] == [("row", f"{r}0 | {r}1") for r in range(4)]
    assert got[5] == [("paragraph", "w00 w01 w02\nw10 w11 w12")]
    assert got[6] == [("heading", "Title")]


def plain(box, spans=None):
    """The same cuts, span by span."""
    em = max(float(np.median(box[:, 3] - box[:, 1])), 1e-9)
    spans = list(range(len(box))) if spans is None else spans

    def split(a, b, least, ids):
        parts, reach = [], None
        for i in sorted(ids, key=lambda i: (box[i][a], box[i][b])):
            if reach is None or box[i][a] - reach >= least:
                parts.append(([], 0 if reach is None else box[i][a] - reach))
            parts[-1][0].append(i)
            reach = box[i][b] if reach is None else max(reach, box[i][b])
        return parts

    def cut(ids):
        columns = split(0, 2, em, ids)
        if len(columns) > 1:
            of = {i: k for k, (c, _) in enumerate(columns) for i in c}
            beside = sum(any(of[j] != of[i] and box[j][1] <= (box[i][1] + box[i][3]) / 2 <= box[j][3] for j in ids) for i in ids)
            width = float(np.median([box[i][2] - box[i][0] for i in ids]))
            if beside >= 0.7 * len(ids) and (len(columns) >= 3 or columns[1][1] > width):
                return [("row", sorted(c)) for c, _ in split(1, 3, 0.0, ids)]
            return [x for c, _ in columns for x in cut(c)]
        rows = split(1, 3, 0.6 * em, ids)
        if len(rows) == 1:
            return [("paragraph", sorted(ids))]
        at = max(range(1, len(rows)), key=lambda k: (rows[k][1], -k))
        return cut([i for r, _ in rows[:at] for i in r]) + cut([i for r, _ in rows[at:] for i in r])

    return cut(spans)


@pytest.mark.parametrize("seed", range(40))
def test_cuts_equal_a_plain_version(seed):
    rng = random.Random(seed)
    spans = []
    for _ in range(rng.randint(1, 6)):
        x, y, n = rng.choice([0, 150, 300, 450]), rng.randint(0, 60) * 7, rng.randint(1, 6)
        spans += column(x, y, n, rng.choice([40, 120, 280]), rng.choice([12, 14, 18, 30]))
    box = np.array([s[:4] for s in spans], float)
    got = [(kind, sorted(i for line in lines for i in line)) for kind, lines in geometry.blocks_of(box)]
    assert got == plain(box)
    assert sorted(i for _, ids in got for i in ids) == list(range(len(box)))


def test_odd_spans_and_kinds(spark):
    rows = [(1, None, 0.0, 1.0, 1.0, "x"), (1, float("nan"), 0.0, 1.0, 1.0, "x"), (1, 0.0, 0.0, 1.0, 1.0, "  "), (1, 0.0, 0.0, 1.0, 1.0, None), (2, 0.0, 0.0, 5.0, 0.0, "flat"), (2, 0.0, 0.0, 5.0, 0.0, "flat"), (None, 0.0, 0.0, 5.0, 1.0, "no page")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page, r.text) for r in geometry.blocks(df).collect()}
    assert got == {(2, "flat flat"), (None, "no page")}
    assert geometry.blocks(df.limit(0)).count() == 0
    told = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, "x" * 50), (2, 0.0, 0.0, 1.0, 1.0, "x" * 30), (3, 0.0, 0.0, 1.0, 1.0, "x"), (4, 0.0, 0.0, 1.0, 1.0, None)], SCHEMA)
    kinds = {r.page: r.kind for r in geometry.page_kinds(told, spark.createDataFrame([(2,), (4,), (5,), (1,)], "page long")).collect()}
    assert kinds == {1: "text", 2: "mixed", 3: "blank", 4: "scan", 5: "scan"}
