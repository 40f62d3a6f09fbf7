"""Token counts by the compiled transducer of a SentencePiece vocabulary, over chunks of text.

A text is a row of symbols: code points, the space as U+2581, an added space first. Before a symbol at which
a merge can't cross (a space behind another character, a pair of characters that no piece holds
side by side, a character in no piece) the transducer starts anew, so the state map of the symbols from such
a bound to the next, a segment, is constant: one count, kept by the segment's hash. Segments that are not kept are cut
into chunks of CHUNK symbols; all chunks of a window run side by side, one numpy step a symbol, through a
hash table of the transitions that have been met, each with the change in emitted tokens.

A chunk's state map takes the state before it to the state after it and the tokens it emits. It is known at
START and at the state that the chunk before ends in; a path from another state is followed only until it
meets the one from START. Where paths never meet, further states are
added until the maps are closed. The maps then compose in a segmented parallel prefix scan: after step k
each chunk's map covers up to 2**k chunks back, never beyond its segment's first one. A window ends in
a state that the next one starts from, so a text of any length needs the memory of one window. A text's
count is the sum over its segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import _text as T
from scholia.llm import pieces
from scholia.llm.language_id import points

CHUNK = 128
WINDOW_BYTES = 1 << 19
#: Segments whose counts a worker keeps.
MOST_COUNTS = 400_000
SPACE = ord(pieces.SPACE)


class Transitions:
    """Transitions of an automaton that have been met, as arrays: state and symbol to next state and emitted tokens."""

    def __init__(self, automaton: pieces.Automaton) -> None:
        self.a = automaton
        self._empty(1 << 14)

    def _empty(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.next, self.emits = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys.view(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, or -1."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, slot, -1)
        rest = np.flatnonzero((out < 0) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (found >= 0)]
        return out

    def _put(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """Adds distinct new keys."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = self.keys, self.next, self.emits
            some = np.flatnonzero(old[0] >= 0)
            self._empty(1 << (4 * self.used).bit_length())
            keys, to, emits = (np.concatenate([x[some], y]) for x, y in zip(old, (keys, to, emits), strict=True))
            self.used = len(keys)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]
            placed = free[self.keys[slot[free]] == keys[free]]  # of several for one slot, the last one got it
            self.next[slot[placed]], self.emits[slot[placed]] = to[placed], emits[placed]
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted tokens."""
        keys = (state.astype(np.int64) << 21) | symbol
        at = self._find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = np.unique(keys[missing])
            moves = [self.a._move(key >> 21, key & 0x1FFFFF) for key in new.tolist()]
            self._put(new, np.array([m[0] for m in moves], np.int32), np.array([m[1] for m in moves], np.int32))
            at = self._find(keys)
        return self.next[at], self.emits[at]

    def tidy(self, state: int) -> int:
        """Forgets all transitions once there are many; the number of the state from then on."""
        if self.used > pieces.MOST_MOVES or len(self.a.states) > pieces.MOST_STATES:
            held = self.a.states[state]
            self.a._reset()
            self._empty(1 << 14)
            return self.a.number(held)
        return state


def compose(later_to: np.ndarray, later_n: np.ndarray, to: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps (rows: start state to end state, tokens) followed by others."""
    return np.take_along_axis(later_to, to, axis=1), n + np.take_along_axis(later_n, to, axis=1)


def scanned(to: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of maps: row i becomes the composition of the depth[i] + 1 maps up to it, by doubling."""
    span = 1
    while span <= int(depth.max(initial=0)):
        # before this step a row covers min(span, depth + 1) maps; the row `span` back covers the ones before
        at = np.flatnonzero(depth >= span)
        new_to, new_n = compose(to[at], n[at], to[at - span], n[at - span])
        to[at], n[at] = new_to, new_n
        span *= 2
    return to, n


class Counter:
    """Counts over windows of texts."""

    def __init__(self, automaton: pieces.Automaton, chunk: int = CHUNK, window: int = WINDOW_BYTES) -> None:
        self.a, self.chunk, self.window = automaton, chunk, window
        self.t = Transitions(automaton)
        self.known: dict[int, int] = {}

    def _bounds(self, symbols: np.ndarray, first: np.ndarray, before: int) -> np.ndarray:
        """Whether the transducer starts anew before each symbol."""
        v = self.a.v
        previous = np.empty_like(symbols)
        previous[0], previous[1:] = before, symbols[:-1]
        low = symbols < 128
        bound = first | ((symbols == SPACE) & (previous != SPACE))
        bound |= low & v.apart[np.where(low, symbols, 0)]
        both = low & (previous < 128)
        bound |= both & ~v.joint[np.where(both, previous, 0), np.where(both, symbols, 0)]
        return bound

    def _run(self, symbols, bound, at, length, state, path=None):
        """Runs chunks (first symbol, length, start state) to their ends: end states, tokens, and the path of states and of tokens so far.

        With the path of other runs over the same chunks, a chunk that meets it takes its rest from there.
        """
        steps = int(length.max(initial=0))
        states, counts = (np.zeros((steps + 1, len(at)), np.int32) for _ in range(2)) if path is None else (None, None)
        end, total = state.astype(np.int32), np.zeros(len(at), np.int32)
        live = np.argsort(-length, kind="stable")
        sizes = length[live]
        for i in range(steps):
            stop = int(np.searchsorted(-sizes, -i, side="left"))  # chunks longer than i
            live, sizes = live[:stop], sizes[:stop]
            if path is not None:
                fresh = bound[at[live] + i]
                met = (end[live] == path[0][i, live]) | fresh
                done = live[met]
                total[done] += path[1][length[done], done] - path[1][i, done]
                end[done] = path[0][length[done], done]
                live, sizes = live[~met], sizes[~met]
            if len(live) == 0:
                break
            where = at[live] + i
            now = np.where(bound[where], 0, end[live])
            end[live], emitted = self.t.step(now, symbols[where])
            total[live] += emitted
            if path is None:
                states[i + 1, live], counts[i + 1, live] = end[live], total[live]
        if path is None:
            states[0] = state
        return end, total, states, counts

    def _mapped(self, symbols: np.ndarray, bound: np.ndarray, owner: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Tokens of each segment (owner) of the symbols, and the state after them. `state`: that before the first symbol, unless it is a bound."""
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(begin, len(symbols)))
        per = -(-size // self.chunk)
        depth = np.arange(per.sum()) - np.repeat(np.append(0, np.cumsum(per))[:-1], per)  # number of the chunk in its segment
        at = np.repeat(begin, per) + depth * self.chunk
        length = np.minimum(self.chunk, np.repeat(begin + size, per) - at)
        end, total, states, counts = self._run(symbols, bound, at, length, np.zeros(len(at), np.int32))
        # state maps: for each chunk the start states for which it is known; number 0 is START
        starts = [np.zeros(len(at), np.int32)]
        ends, tokens = [end], [total]
        asked = np.full(len(at), -1, np.int32)
        follows = np.flatnonzero(depth > 0)
        asked[follows] = end[follows - 1]
        if not bound[0]:
            asked[0] = state  # the text goes on from the window before
        while True:
            asked[np.any([asked == s for s in starts], axis=0)] = -1
            some = np.flatnonzero(asked >= 0)
            if len(some) == 0:
                break
            new_end, new_total, _, _ = self._run(symbols, bound, at[some], length[some], asked[some], (states[:, some], counts[:, some]))
            starts.append(np.where(asked >= 0, asked, 0))
            ends.append(end.copy())
            tokens.append(total.copy())
            ends[-1][some], tokens[-1][some] = new_end, new_total
            asked = np.full(len(at), -1, np.int32)
            asked[follows] = ends[-1][follows - 1]
        # ends as numbers of the next chunk's start states; the last chunk of a segment ends the scan
        k = len(starts)
        to = np.zeros((len(at), k), np.int64)
        for j in range(k):
            for i in range(k - 1, -1, -1):
                to[:-1, j][ends[j][:-1] == starts[i][1:]] = i
        n = np.stack(tokens, axis=1).astype(np.int64)
        upto, n = scanned(to, n, depth)
        last = np.cumsum(per) - 1
        start = np.zeros(len(begin), np.int64)
        if not bound[0]:
            start[0] = next(i for i in range(k) if starts[i][0] == state)
        number = int(upto[-2, start[-1]]) if per[-1] > 1 else int(start[-1])
        return n[last, start], int(ends[number][-1])

    def _window(self, symbols: np.ndarray, owner: np.ndarray, first: np.ndarray, state: int, before: int) -> tuple[np.ndarray, int]:
        """Tokens by text of a window's symbols, and the state after them. `state`: that before the first symbol."""
        bound = self._bounds(symbols, first, before)
        begin = np.flatnonzero(bound | (np.arange(len(symbols)) == 0))
        end = np.append(begin[1:], len(symbols))
        # the first segment may go on from the window before, and the last into the next: these are not looked up
        alone = np.unique([0] * (not bound[0]) + [len(begin) - 1])
        inner = np.setdiff1d(np.arange(len(begin)), alone)
        keys, number, _ = T.distinct(T.span_hashes(symbols, begin[inner], end[inner]))
        tokens = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(tokens < 0)
        one = np.zeros(len(keys), np.int64)
        one[number] = inner  # a segment of each key
        run = np.concatenate([one[new], alone])
        order = np.argsort(run)
        size = (end - begin)[run[order]]
        take = np.repeat(begin[run[order]] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        counted, state = self._mapped(symbols[take], bound[take], np.repeat(np.arange(len(run)), size), state)
        of = np.empty(len(run), np.int64)
        of[order] = counted
        tokens[new] = of[: len(new)]
        if len(self.known) > MOST_COUNTS:
            self.known.clear()
        self.known.update(zip(keys[new].tolist(), tokens[new].tolist(), strict=True))
        each = np.empty(len(begin), np.int64)
        each[inner], each[alone] = tokens[number], of[len(new) :]
        return np.bincount(owner[begin], weights=each, minlength=int(owner[-1]) + 1).astype(np.int64), state

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if self.a.v.prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            grown = np.zeros(len(out), np.int64)
            grown[full] = 1
            offsets = offsets + np.append(0, np.cumsum(grown))
        state, before, at = 0, -1, 0
        while at < len(data):
            to = min(at + self.window, len(data))
            while to < len(data) and (data[to] & 0xC0) == 0x80:
                to += 1
            lo = int(np.searchsorted(offsets, at, side="right")) - 1
            hi = int(np.searchsorted(offsets, to, side="left"))
            bounds = np.clip(offsets[lo : hi + 1], at, to) - at
            symbols, places = points(data[at:to], bounds)
            symbols = symbols.astype(np.int64)
            symbols[symbols == 32] = SPACE
            owner = np.repeat(np.arange(hi - lo), np.diff(places))
            first = np.zeros(len(symbols), bool)
            begins = places[:-1][(offsets[lo:hi] >= at) & (np.diff(places) > 0)]
            first[begins] = True
            state = self.t.tidy(state)
            counted, state = self._window(symbols, owner, first, state, before)
            out[lo : lo + len(counted)] += counted
            before, at = int(symbols[-1]), to
        return out


def counter(path: str) -> Counter:
    """This worker's counter for a vocabulary file; its transitions are bounded."""
    return T.kept(f"counter {path}", lambda: Counter(pieces.Automaton(pieces.Vocabulary(path))))


def _counted(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(path or pieces.default_path())
        # a vocabulary of scored pieces has no counts on its transitions
        count = held.count if held.a.v.bpe else lambda data, offsets: np.diff(pieces.words(path or pieces.default_path()).encode(data, offsets)[1])
        for b in batches:
            _, sizes = T.buffers(b.column("text"))
            data, offsets = T.buffers(pieces.plain(b.column("text")))
            out = np.zeros(len(offsets) - 1, np.int64)
            for i, j, part, bounds in T.runs(data, offsets):
                out[i:j] = count(part, bounds)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(sizes)), pa.array(out)], names=["id", "n_bytes", "n_tokens"])

    return run


def counts(docs: DataFrame, text: str, row_id: str, *, path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens of each row; null and empty texts have 0 of both. `path`: the vocabulary file on every executor.

    Repeated rows and ids stay as they are; other columns play no part; an empty table gives no rows.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(_counted(path), f"id {kind}, n_bytes long, n_tokens long")
