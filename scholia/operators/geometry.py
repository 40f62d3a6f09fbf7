"""Reading order of pages from the places of their words: blocks, columns, table rows and the kind of a page, for spans (page, x0, y0, x1, y1, text).

A page is cut where no span stands: first into columns at gaps between x ranges, else at its widest gap between y ranges, and each part again, until
nothing can be cut. Columns whose lines stand beside each other with short cells are a table, which is read row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least gaps between columns and between blocks, in median heights of a page's spans; the share of a table's cells with a neighbour.
COLUMN_GAP, BLOCK_GAP, ALIGNED = 1.0, 0.6, 0.7
# What a page with less text is, and what a first block ends with that is a heading.
BLANK, FEW = 20, 40
HEADING_ENDS = (")", "]", "»")


def _gaps(low: np.ndarray, high: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the intervals, and places in it before which a gap of at least `least` stands, with the gaps."""
    order = np.lexsort((high, low))
    reach = np.maximum.accumulate(high[order])
    gap = low[order][1:] - reach[:-1]
    at = np.flatnonzero(gap >= least) + 1
    return order, at, gap[at - 1]


def _is_table(columns: list[np.ndarray], box: np.ndarray, gaps: np.ndarray) -> bool:
    """Whether most cells have a neighbour in another column at their height, and columns are three or more, or two further apart than their cells are wide."""
    beside = 0
    for i, own in enumerate(columns):
        others = np.concatenate([c for j, c in enumerate(columns) if j != i])
        middle = (box[own, 1] + box[own, 3]) / 2
        beside += int(((box[others, 1][None, :] <= middle[:, None]) & (middle[:, None] <= box[others, 3][None, :])).any(1).sum())
    width = float(np.median(box[np.concatenate(columns), 2] - box[np.concatenate(columns), 0]))
    return beside >= ALIGNED * sum(map(len, columns)) and (len(columns) >= 3 or float(gaps.min()) > width)


def blocks_of(box: np.ndarray) -> list[tuple[str, list[list[int]]]]:
    """Blocks in reading order: kind (paragraph or row), and the numbers of their spans line by line. box: x0, y0, x1, y1 of each span."""
    if len(box) == 0:
        return []
    em = max(float(np.median(box[:, 3] - box[:, 1])), 1e-9)
    out, open_ = [], [np.arange(len(box))]
    while open_:
        part = open_.pop()
        own = box[part]
        order, at, gaps = _gaps(own[:, 0], own[:, 2], COLUMN_GAP * em)
        if len(at):
            columns = [part[x] for x in np.split(order, at)]
            if _is_table(columns, box, gaps):
                order, at, _ = _gaps(own[:, 1], own[:, 3], 0.0)
                out += [("row", [_line(part[x], box)]) for x in np.split(order, at)]
            else:
                open_ += columns[::-1]  # the left one comes first
            continue
        order, at, gaps = _gaps(own[:, 1], own[:, 3], BLOCK_GAP * em)
        if len(at):
            cut = at[int(gaps.argmax())]  # of equal gaps, the upper one
            open_ += [part[order[cut:]], part[order[:cut]]]
        else:
            out.append(("paragraph", _lines(part, box)))
    return out


def _line(spans: np.ndarray, box: np.ndarray) -> list[int]:
    return sorted(spans.tolist(), key=lambda i: (box[i, 0], box[i, 1], i))


def _lines(spans: np.ndarray, box: np.ndarray) -> list[list[int]]:
    """Spans of a block by lines: one belongs to the line whose middle it spans."""
    out: list[list[int]] = []
    for i in sorted(spans.tolist(), key=lambda i: (box[i, 1], box[i, 0], i)):
        if out and box[i, 1] <= (box[out[-1][0], 1] + box[out[-1][0], 3]) / 2 <= box[i, 3]:
            out[-1].append(i)
        else:
            out.append([i])
    return [_line(np.array(x), box) for x in out]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, pages = [], []
        for r, spans in enumerate(b.column("spans").to_pylist()):
            box = np.array([(s["x0"], s["y0"], s["x1"], s["y1"]) for s in spans], float).reshape(-1, 4)
            for place, (kind, lines) in enumerate(blocks_of(box)):
                own = [i for line in lines for i in line]
                joint = " | " if kind == "row" else " "
                text = "\n".join(joint.join(spans[i]["text"] for i in line) for line in lines).strip()
                low = text.lower()
                if place == 0 and kind == "paragraph" and len(low) < 120 and (low.endswith(HEADING_ENDS) or " " not in low):
                    kind = "heading"
                rows.append({"place": place, "kind": kind, "x0": box[own, 0].min(), "y0": box[own, 1].min(), "x1": box[own, 2].max(), "y1": box[own, 3].max(), "text": text})
                pages.append(r)
        names = ["place", "kind", "x0", "y0", "x1", "y1", "text"]
        kinds = [pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("page").take(pa.array(pages, pa.int64())), *(pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True))], names=["page", *names])


def blocks(spans: DataFrame) -> DataFrame:
    """page, place, kind (heading, paragraph, row), x0, y0, x1, y1, text of each page's blocks in reading order.

    Spans without text, or with a place that is null or not a number, take no part; a page without any has no blocks. Of spans at the same place the order is
    that of their texts. A page's spans have to fit in a task.
    """
    sides = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    usable = F.length(F.trim("text")) > 0
    for s in sides:
        usable = usable & s.isNotNull() & ~F.isnan(s)
    kind = spans.schema["page"].dataType.simpleString()
    span = F.struct("text", *(s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)))
    pages = spans.where(usable).groupBy("page").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return pages.mapInArrow(_read, f"page {kind}, place int, kind string, x0 double, y0 double, x1 double, y1 double, text string")


def page_kinds(spans: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """page, characters, kind: scan (images and no text), mixed (images and little text), blank, or text. images: page."""
    text = spans.groupBy("page").agg(F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)).alias("characters"))
    held: Column = F.lit(False)
    if images is not None:
        pictured = images.select("page", F.lit(True).alias("pictured")).distinct()
        text = text.join(pictured, "page", "full").withColumn("characters", F.coalesce("characters", F.lit(0)))
        held = F.coalesce("pictured", F.lit(False))
    n = F.col("characters")
    return text.select("page", n.cast("long").alias("characters"), F.when(held & (n == 0), "scan").when(held & (n < FEW), "mixed").when(n < BLANK, "blank").otherwise("text").alias("kind"))
