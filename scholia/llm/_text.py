"""Vectorised work on Arrow string columns: whole texts, as one byte array with offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, which bounds a worker's memory.
RUN_BYTES = 1 << 19

T = TypeVar("T")
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _pow_table(name: str, base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; grows by doubling and is kept by the worker."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, RUN_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 4 * RUN_BYTES:
            _powers[name] = table
    return table


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What a worker keeps between tasks: one thing at a time, by name; another one takes its place. Its own bounds are its maker's."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Lets go of what the worker keeps: a task that has no use for it calls this first."""
    _kept.clear()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32, count=len(column) + 1, offset=column.offset * (8 if large else 4)).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about `most` bytes: first and past-last text, bytes, offsets. A longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def tokens(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal stretch of bytes marked `inside`; a text's bounds end a stretch."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def is_word(data: np.ndarray) -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    return (data != 32) & ((data < 9) | (data > 13))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial; the same bytes hash alike anywhere."""
    n = len(data)
    power, inverse = _pow_table("p", _P, n + 1), _pow_table("i", _P_INV, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sums_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values for each owner 0..n-1."""
    return np.bincount(owner, weights=values, minlength=n)[:n]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in no order, the number of each key's distinct value, and counts.

    Sorts one word of mixed key and position, which is far quicker than an argsort; where two keys
    share the key bits that are left, an argsort it is.
    """
    n = len(keys)
    if n == 0:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    packed = (mix(keys) & ~mask) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    ranked = keys[order]
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    packed &= ~mask
    if (first[1:] & (packed[1:] == packed[:-1])).any():
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(first)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(first) - 1
    return ranked[at], number, np.diff(np.append(at, n))


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted table; -1 where absent."""
    if len(table) == 0:
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Values:
    """Values by key: a sorted table, and the keys of most `weight` in a small direct-mapped one that stays in the cache."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray, bits: int = 17) -> None:
        order = np.argsort(keys)
        self.keys, self.values, self.bits = keys[order], values[order], bits
        heavy = np.argsort(weight)[-(1 << bits) // 2 :]
        self._place(keys[heavy], values[heavy])

    @classmethod
    def sorted(cls, whole: pa.Table, heavy: pa.Table, bits: int) -> Values:
        """From a table (key, value) in the order of the keys, and its rows of most weight, the heaviest first."""
        self = cls.__new__(cls)
        self.keys, self.values, self.bits = whole.column("key").to_numpy().view(np.uint64), whole.column("value").to_numpy(), bits
        self._place(heavy.column("key").to_numpy().view(np.uint64)[::-1], heavy.column("value").to_numpy()[::-1])
        return self

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)  # the heaviest come last and stand where slots clash
        self.near_keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.near = np.zeros(1 << self.bits, values.dtype)
        self.near_keys[slot] = keys
        self.near[slot] = values

    def get(self, keys: np.ndarray, absent: float) -> np.ndarray:
        slot = (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.near[slot]
        rest = np.flatnonzero((self.near_keys[slot] != keys) | (keys == np.uint64(0xFFFFFFFFFFFFFFFF)))
        if len(rest):
            found, number, _ = distinct(keys[rest])
            ordered = np.argsort(found)
            at = np.empty(len(found), np.int64)
            at[ordered] = lookup(self.keys, found[ordered])
            own = np.full(len(found), absent, self.values.dtype)
            own[at >= 0] = self.values[at[at >= 0]]
            out[rest] = own[number]
        return out
