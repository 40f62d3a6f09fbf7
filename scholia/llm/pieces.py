"""A SentencePiece vocabulary compiled to a deterministic transducer, and exact segmentation with it.

The segmentation of a BPE vocabulary is the only path through the lattice of pieces on which every two
neighbours stay apart when merged on their own. So the last piece of every prefix follows from the last
pieces of shorter prefixes, no further back than the longest piece. The transducer's states are what can still
matter of them: for each start from which some piece can still grow, the text since then, the last
piece before it and its count. Its transitions carry the piece that ends there and the change in
the number of emitted tokens. States are made when first met, up to MOST_STATES, after which the table is
emptied. A vocabulary of scored pieces (unigram) is segmented by the best sum of scores.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from scholia.llm import _text as T

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MOST_STATES = 60_000
MOST_MOVES = 240_000
MOST_PAIRS = 300_000
#: Bytes of the words that a worker keeps, and of an entry besides its ids.
MOST_KEPT, ENTRY = 64 << 20, 150
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    """Pieces by text, their ids and scores; byte pieces; what may be cut without looking further."""

    def __init__(self, path: str) -> None:
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.bpe = model.trainer_spec.model_type == 2
        self.prefix = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only vocabularies without normalisation and with byte fallback are supported")
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.scores = [p.score for p in model.pieces]
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        spaces = [p for p in self.ids if set(p) == {SPACE}]
        if any(SPACE in p[1:] for p in self.ids if set(p) != {SPACE}):
            raise ValueError("pieces with an inner space are not supported")
        if len(spaces) > 1 and max(self.scores[self.ids[p]] for p in spaces if len(p) > 1) >= min(self.scores[i] for p, i in self.ids.items() if set(p) != {SPACE}):
            raise ValueError("runs of spaces must merge last")
        used = {c for p in self.ids for c in p}
        #: Bytes that are a character in no piece: each is its own byte piece, and a bound.
        self.apart = np.array([b < 128 and b != 32 and chr(b) not in used for b in range(256)])
        #: Byte pairs between which a merge can happen; others always part. Bytes beyond ASCII may join with any.
        self.joint = np.ones((256, 256), bool)
        self.joint[:128, :128] = False
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                if ord(x) < 128 and ord(y) < 128:
                    self.joint[ord(x), ord(y)] = True
        raw = [p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in model.pieces]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.append(0, np.cumsum([len(x) for x in raw]))

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first, until none is a piece."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Automaton:
    """The transducer of a vocabulary. Pieces are ids; a character in no piece is minus its code point less one."""

    START = 0

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # a trie over all pieces: children by node and character, the piece that ends in a node, whether a longer one goes on
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.grows: list[bool] = [True]
        for piece, i in vocabulary.ids.items():
            node = 0
            for c in piece:
                self.grows[node] = True
                key = node << 21 | ord(c)
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
            self.ends[node] = i
        self.lengths = [len(x) for x in vocabulary.texts]
        self._apart: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list]] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the starts that can still grow, as (trie node since then, last piece before, its count or score less that of the whole prefix, characters since)
        self.states: list[tuple] = [((0, -1, 0, 0),)]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int, int]] = {}  # by state and code point: state, tokens emitted, piece that ends

    def _tree(self, piece: str) -> tuple[list, list]:
        """The symbols at a piece's left and right edge while it is merged: text, when it forms, when it goes on into the next.

        The time of a merge is the largest rank of the merges that it waits for; ranks are scores turned round.
        """
        v = self.v
        parts = [(c, 0.0, None) for c in piece]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = v.ids.get(parts[i][0] + parts[i + 1][0])
                if found is not None and (best is None or v.scores[found] > best):
                    best, at = v.scores[found], i
            if at < 0:
                return [], []  # merging never gets to this piece
            left, right = parts[at], parts[at + 1]
            parts[at : at + 2] = [(left[0] + right[0], max(-best, left[1], right[1]), (left, right))]
        out = []
        for side in (0, 1):
            chain, node, until = [], parts[0], float("inf")
            while node is not None:
                chain.append((node[0], node[1], until))
                until, node = node[1], node[2][side] if node[2] else None
            out.append(chain)
        return out[0], out[1]

    def _chains(self, i: int) -> tuple[list, list]:
        known = self._edges.get(i)
        if known is None:
            known = self._edges[i] = self._tree(self.v.texts[i])
        return known

    def _check(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart: no symbols at their bound meet while both are there and merge before either goes on."""
        v = self.v
        left, right = self._chains(a)[1], self._chains(b)[0]
        if left and right:
            sure = True
            for x, formed_x, gone_x in left:
                for y, formed_y, gone_y in right:
                    if formed_x >= gone_y or formed_y >= gone_x:
                        sure &= formed_x != gone_y and formed_y != gone_x
                        continue
                    found = v.ids.get(x + y)
                    if found is not None:
                        at = max(-v.scores[found], formed_x, formed_y)
                        if at < gone_x and at < gone_y:
                            return False
                        sure &= at not in (gone_x, gone_y)
            if sure:
                return True
        # two merges at one time: their order in the text decides
        return v.merged(v.texts[a] + v.texts[b]) == [v.texts[a], v.texts[b]]

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= MOST_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._check(a, b)
        return known

    def _move(self, state: int, c: int) -> tuple[int, int, int]:
        bpe, scores, child, ends, grows, apart = self.v.bpe, self.v.scores, self.child.get, self.ends, self.grows, self._apart.get
        piece, total, alive = -1, 0, []
        for node, last, count, since in self.states[state]:
            to = child(node << 21 | c)
            if to is None:
                continue
            if grows[to]:
                alive.append((to, last, count, since + 1))
            i = ends[to]
            if i < 0:
                continue
            if not bpe:
                new = count + scores[i]
                if piece < 0 or new > total:
                    piece, total = i, new
            elif piece < 0:
                stay = True if last < 0 else apart(last << 20 | i)
                if stay is None:
                    stay = self._stay_apart(last, i)
                if stay:
                    piece, total = i, count + 1
        if piece < 0:
            # a character in no piece is a bound, and as many byte pieces as it has bytes
            return 0, len(chr(c).encode()), -c - 1
        after = (*[(to, last, count - total, since) for to, last, count, since in alive], (0, piece if bpe else -1, 0, 0))
        return self.number(after), total, piece

    def number(self, state: tuple) -> int:
        """The number of a state, a new one if it has none."""
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    def _length(self, piece: int) -> int:
        return self.lengths[piece] if piece >= 0 else 1

    def lasts(self, word: str) -> list[int]:
        """The last piece of each prefix of a word."""
        self._tidy()
        state, out, moves = 0, [], self.moves
        for c in map(ord, word):
            move = moves.get(state << 21 | c)
            if move is None:
                move = moves[state << 21 | c] = self._move(state, c)
            state = move[0]
            out.append(move[2])
        return out

    def _tidy(self) -> None:
        self.tidied(self.START)

    def tidied(self, state: int) -> int:
        """Forgets the states and transitions once there are many; the number of the state from then on."""
        if len(self.states) <= MOST_STATES and len(self.moves) <= MOST_MOVES:
            return state
        held = self.states[state]
        self._reset()
        return self.number(held)

    def encode(self, word: str) -> list[int]:
        """Ids of a word: the streaming search of `Stream`, in one go."""
        stream = Stream(self)
        return stream.push(word) + stream.end()

    def ids_of(self, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.v.bytes[b] for b in chr(-piece - 1).encode()]


class Stream:
    """Streaming Viterbi over one text: holds the positions after the last committed boundary.

    After every STRIDE characters the survivors are the starts from which a piece can still grow; they lie
    within the longest piece from the end. When their paths of back pointers meet in one boundary, what is
    before it is committed. Words end where all paths meet by themselves (a space, or a pair of characters that no piece
    holds): there all is committed, so that the window is no longer than a word, and a word's ids can be kept.
    """

    STRIDE = 64

    def __init__(self, automaton: Automaton) -> None:
        automaton._tidy()
        self.a = automaton
        self.state = Automaton.START
        self.lasts: list[int] = []  # last piece of each prefix after the committed boundary

    def push(self, text: str) -> list[int]:
        a, out, at = self.a, [], 0
        while at < len(text):
            lasts, state, moves = self.lasts, self.state, a.moves
            part = text[at : at + self.STRIDE - len(lasts) % self.STRIDE]
            at += len(part)
            for c in map(ord, part):
                move = moves.get(state << 21 | c)
                if move is None:
                    move = moves[state << 21 | c] = a._move(state, c)
                state = move[0]
                lasts.append(move[2])
            self.state = state
            if len(lasts) % self.STRIDE == 0:
                out += self._commit()
                self.state = a.tidied(state)  # long words too keep the tables bounded
        return out

    def _back(self, to: int) -> list[int]:
        pieces, at, lasts, lengths = [], to, self.lasts, self.a.lengths
        while at > 0:
            piece = lasts[at - 1]
            pieces.append(piece)
            at -= lengths[piece] if piece >= 0 else 1
        return pieces[::-1]

    def _ids(self, to: int) -> list[int]:
        pieces = self._back(to)
        return pieces if not pieces or min(pieces) >= 0 else [i for piece in pieces for i in self.a.ids_of(piece)]

    def _commit(self) -> list[int]:
        n = len(self.lasts)
        alive = {n - since for _, _, _, since in self.a.states[self.state]}
        alive = {max(0, at) for at in alive}
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - self.a._length(self.lasts[last - 1]) if last else 0)
        at = alive.pop()
        out = self._ids(at)
        self.lasts = self.lasts[at:]
        return out

    def end(self) -> list[int]:
        out = self._ids(len(self.lasts))
        self.state, self.lasts = Automaton.START, []
        return out


class Words:
    """A worker's automaton and the words it has segmented, bounded by their bytes; over whole texts, in batches."""

    def __init__(self, path: str, most: int = MOST_KEPT) -> None:
        self.v = Vocabulary(path)
        self.a = Automaton(self.v)
        self.most = most
        self.known: dict[int, bytes] = {}  # ids of words, four bytes each
        self.kept = 0
        self._runs: dict[int, list[int]] = {}

    def spaces(self, k: int) -> list[int]:
        """Ids of a run of k spaces; a long one is cut where merging cuts it, after each longest piece."""
        if k not in self._runs:
            long = max(len(p) for p in self.v.ids if set(p) == {SPACE})
            whole = max(0, k // long - 2)
            self._runs[k] = [self.v.ids[SPACE * long]] * whole + [i for p in self.v.merged(SPACE * (k - whole * long)) for i in [self.v.ids[p]]] if self.v.bpe else self.a.encode(SPACE * k)
        return self._runs[k]

    def items(self, data: np.ndarray, offsets: np.ndarray):
        """Words, runs of spaces and bytes apart, of texts that begin with the added space.

        Returns the padded bytes, word starts and ends and texts, whether a space precedes; runs of spaces; bytes apart.
        """
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        if self.v.prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            grown = np.zeros(n, np.int64)
            grown[full] = 1
            offsets = offsets + np.append(0, np.cumsum(grown))
        space, apart = data == 32, self.v.apart[data]
        inside = ~space & ~apart
        starts, ends, owner = T.tokens(inside, offsets)
        if self.v.bpe and len(data) > 1:
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = inside[1:] & inside[:-1] & ~self.v.joint[data[:-1], data[1:]]
            cut[offsets] = False
            cuts = np.flatnonzero(cut)
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            owner = np.searchsorted(offsets, starts, side="right") - 1
        return data, offsets, (starts, ends, owner), T.tokens(space, offsets), np.flatnonzero(apart)

    def _texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [(SPACE if s else "") + raw[a:b].decode() for a, b, s in zip(starts.tolist(), ends.tolist(), spaced.tolist(), strict=True)]

    def _distinct(self, data, starts, ends, spaced):
        h = T.span_hashes(data, starts, ends)
        h = np.where(spaced, T.mix(h + np.uint64(1)), h)
        at, number, _ = T.distinct(h)
        first = np.zeros(len(at), np.int64)
        first[number] = np.arange(len(h))
        return at.tolist(), number, first

    def _before(self, starts, owner, runs, offsets) -> np.ndarray:
        """Number of the run of spaces right before each word, or -1."""
        if len(runs[0]) == 0:
            return np.full(len(starts), -1)
        at = np.searchsorted(runs[1], starts)
        at[at == len(runs[1])] = 0
        return np.where((runs[1][at] == starts) & (starts > offsets[owner]), at, -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets in them."""
        n = len(offsets) - 1
        data, offsets, (starts, ends, owner), runs, apart = self.items(data, offsets)
        run = self._before(starts, owner, runs, offsets)
        keys, number, first = self._distinct(data, starts, ends, run >= 0)
        known = self.known
        if self.kept > self.most:
            known.clear()
            self.kept = 0
        missing = [i for i, k in enumerate(keys) if k not in known]
        at = first[missing] if missing else np.zeros(0, np.int64)
        # in the order of the words: those that begin alike find their states in the processor's cache
        for word, i in sorted(zip(self._texts(data, starts[at], ends[at], run[at] >= 0), missing, strict=True)):
            ids = self.a.encode(word)
            known[keys[i]] = struct.pack(f"<{len(ids)}i", *ids)
            self.kept += len(known[keys[i]]) + ENTRY
        lists = [known[k] for k in keys]
        word_ids, word_sizes = np.frombuffer(b"".join(lists), "<i4"), np.array([len(x) >> 2 for x in lists], np.int64)
        lone_id = self.v.ids.get(SPACE, -1)
        if lists:
            lone = ((word_sizes > 1) & (word_ids[np.append(0, np.cumsum(word_sizes))[:-1]] == lone_id))[number] & (run >= 0)
        else:
            lone = np.zeros(0, bool)
        length = runs[1] - runs[0]
        taken = run[(run >= 0) & ~lone]
        length[taken] -= 1
        some, back = np.unique(length, return_inverse=True) if len(length) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        run_lists = [self.spaces(k) if k else [] for k in some.tolist()]
        flat = np.concatenate([word_ids, np.array([i for x in run_lists for i in x] + self.v.bytes, np.int32)])
        sizes = np.concatenate([word_sizes, np.array([len(x) for x in run_lists] + [1] * 256, np.int64)])
        begin = np.append(0, np.cumsum(sizes))[:-1]
        place = np.concatenate([starts, runs[0], apart])
        item = np.concatenate([number, len(lists) + back, len(lists) + len(run_lists) + data[apart].astype(np.int64)]) if len(place) else np.zeros(0, np.int64)
        skip = np.concatenate([lone.astype(np.int64), np.zeros(len(runs[0]) + len(apart), np.int64)])
        order = np.argsort(place)
        item, skip, place = item[order], skip[order], place[order]
        take = sizes[item] - skip
        bounds = np.append(0, np.cumsum(take))
        ids = flat[np.repeat(begin[item] + skip - bounds[:-1], take) + np.arange(bounds[-1])]
        return ids, bounds[np.searchsorted(place, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another, without the added space, and their offsets."""
        size = np.diff(self.v.raw_at)[ids]
        bounds = np.append(0, np.cumsum(size))
        data = self.v.raw[np.repeat(self.v.raw_at[ids] - bounds[:-1], size) + np.arange(bounds[-1])]
        out = bounds[offsets]
        if self.v.prefix:
            full = np.flatnonzero(np.diff(out) > 0)
            data = np.delete(data, out[:-1][full])
            less = np.zeros(len(out) - 1, np.int64)
            less[full] = 1
            out = out - np.append(0, np.cumsum(less))
        return data, out


def words(path: str, most: int = MOST_KEPT) -> Words:
    """This worker's words for a vocabulary file, of which it keeps about `most` bytes."""
    return T.kept(f"words {path} {most}", lambda: Words(path, most))


def plain(column: pa.Array) -> pa.Array:
    """The column with the space mark itself read as a space, as the library does; a null is an empty text."""
    column = column.fill_null("")
    return pc.replace_substring(column, SPACE, " ") if pc.any(pc.match_substring(column, SPACE)).as_py() else column
