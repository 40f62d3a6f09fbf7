"""SentencePiece encoding and decoding of whole texts by a streaming Viterbi search.

`pieces.Stream` is the search: it keeps what follows the last committed boundary, a window that the longest
piece bounds apart from paths that have not met yet. Words of a batch are encoded once each; ids equal the
library's. Decoding the ids gives the text back, but that the space mark U+2581 comes back as a space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm import pieces


def _encoded(path: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = pieces.words(path or pieces.default_path(), most)
        for b in batches:
            data, offsets = T.buffers(pieces.plain(b.column("text")))
            for i, j, part, bounds in T.runs(data, offsets):
                ids, at = w.encode(part, bounds)
                back, back_at = w.decode(ids, at)
                same = np.diff(back_at) == np.diff(bounds)
                if len(back) == len(part):
                    wrong = np.flatnonzero(back != part)
                    same[np.searchsorted(bounds, wrong, side="right") - 1] = False
                else:
                    same &= np.array([np.array_equal(back[p:q], part[r:s]) for p, q, r, s in zip(back_at[:-1], back_at[1:], bounds[:-1], bounds[1:], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), lists, pa.array(np.diff(at)), pa.array(same)], names=["id", "ids", "n_tokens", "exact"])
            pa.default_memory_pool().release_unused()  # what a batch of long texts needed isn't held for the next

    return run


def encode(docs: DataFrame, text: str, row_id: str, *, path: str | None = None, kept_bytes: int = pieces.MOST_KEPT) -> DataFrame:
    """id, ids, n_tokens, exact for each row: exact if decoding gives the same bytes, U+2581 read as a space.

    Null and empty texts have no ids. `path`: the vocabulary file on every executor. kept_bytes: of the words that
    a worker keeps; fewer cost time and change no result.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(_encoded(path, kept_bytes), f"id {kind}, ids array<int>, n_tokens long, exact boolean")


def _decoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = pieces.words(path or pieces.default_path())
        for b in batches:
            column = b.column("ids")
            for i in range(0, len(column), 512):
                part = column.slice(i, 512)
                size = np.array([len(x) if x is not None else 0 for x in part.to_pylist()], np.int64)
                data, at = w.decode(part.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(size)))
                raw = data.tobytes()
                texts = [raw[p:q].decode("utf-8", "replace") for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, 512), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(rows: DataFrame, ids: str, row_id: str, *, path: str | None = None) -> DataFrame:
    """id, text of each row of ids; null or no ids give an empty text, bytes that are no UTF-8 the replacement mark."""
    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(F.col(row_id).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decoded(path), f"id {kind}, text string")
