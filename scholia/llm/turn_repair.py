"""Conversations whose turns are brought back into order by the cheapest edits, found by a rank-compressed DP.

A conversation's rows are kept, given another role, or deleted, and turns may be inserted between them. An insertion run and
the turn it stands before are one macro edit, written as a code: `D`, `IK`, `IR`, `K`, `R`. The codes are in ASCII order and none begins another,
so two audits of the same number of rows compare as the first code in which they differ. A layer of the DP therefore holds for each of
four states (nothing yet, or the last role's initial) a cost, the rank of its audit among the layer's, and a pointer to its parent:
no audit string. Ranks of the next layer follow from the parents' ranks and the codes; audits are written afterwards along the pointers.
Relative costs and ranks take few values, so layers are the states of an automaton and a row costs one lookup.

A table of costs and ranks from each state to each state describes a chunk of rows, and such tables compose. Rows are therefore sorted by ranges over
all tasks, wherever conversations begin and end; only those that a range cuts, or that exceed a chunk, meet again as tables of their chunks.

Longer insertion runs than one before a turn can't be cheapest: two insertions lead back to a state that admits the same.
Nor can insertions before a deletion: after it they cost the same, and `D` comes before `I`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm._spark import written

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CODES = ("D", "IK", "IR", "K", "R")
#: States: nothing yet, after a system, a user or an assistant turn. What an inserted or reroled turn becomes, and what ends a conversation there.
NEXT = (2, 2, 3, 2)
ROLES = (None, "system", "user", "assistant")
ENDS = ("", "II", "I", "")
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: From any state, what another one admits costs at most so much more: states beyond it are lost.
REACH = 12
#: Rows and characters of a chunk.
ROWS, CHARS = 4096, 1 << 20
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

Layer = tuple[tuple[int, int] | None, ...]
Item = tuple[str, bool, int]  # initial (one of sua, or empty), truncated, rows that have to go (0: the turn may stay)


@cache
def _edges(state: int, initial: str, cut: bool) -> tuple[tuple[int, int, int], ...]:
    """(code, next state, cost) of the macro edits of a turn that may stay."""
    out, more = [(0, state, DELETE)], TRUNCATED if cut else 0
    inserted = NEXT[state]
    for code, at, cost in ((1, inserted, INSERT), (3, state, 0)):
        if (at, initial) in KEEPS:
            out.append((code, KEEPS[at, initial], cost + more))
    return (*out, (2, NEXT[inserted], INSERT + REROLE + more), (4, inserted, REROLE + more))


@cache
def _step(layer: Layer, initial: str, cut: bool) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """Next layer with its least cost taken off, that cost, and each state's parent and code."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for p, held in enumerate(layer):
        if held is not None:
            for code, q, cost in _edges(p, initial, cut):
                if best[q] is None or (held[0] + cost, held[1], code, p) < best[q]:
                    best[q] = (held[0] + cost, held[1], code, p)
    low = min(b[0] for b in best if b is not None)
    best = [b if b is not None and b[0] <= low + REACH else None for b in best]
    ranked = sorted((b[1], b[2], q) for q, b in enumerate(best) if b is not None)
    rank = {q: n for n, (_, _, q) in enumerate(ranked)}
    return tuple(b and (b[0] - low, rank[q]) for q, b in enumerate(best)), low, tuple(b and (b[3], b[2]) for b in best)


def _entered(state: int) -> Layer:
    return tuple((0, 0) if p == state else None for p in range(4))


def _run(items: list[Item], state: int) -> tuple[Layer, int, list[tuple[tuple[int, int] | None, ...] | None]]:
    """Last layer, cost to add to it, and the pointers of each item from a state on."""
    layer, total, pointers = _entered(state), 0, []
    for initial, cut, gone in items:
        if gone:
            total += DELETE * gone
            pointers.append(None)
        else:
            layer, low, parents = _step(layer, initial, cut)
            total += low
            pointers.append(parents)
    return layer, total, pointers


def _codes(pointers: list, state: int) -> list[int]:
    """The items' codes along the pointers that end in a state."""
    out = []
    for parents in reversed(pointers):
        if parents is None:
            out.append(0)
        else:
            state, code = parents[state]
            out.append(code)
    return out[::-1]


def _table(items: list[Item]) -> tuple[list[int], list[int]]:
    """Costs and ranks of a chunk from each state (rows) to each state; -1: not reached."""
    costs, ranks = [], []
    for state in range(4):
        layer, total, _ = _run(items, state)
        costs += [-1 if held is None else held[0] + total for held in layer]
        ranks += [-1 if held is None else held[1] for held in layer]
    return costs, ranks


def _end(costs: Iterable[int | None], ranks: Iterable[int | None]) -> tuple[int, int]:
    """Cheapest end: state and cost with the turns that end the conversation; of equals, the least audit."""
    cost, _, state = min((c + INSERT * len(ENDS[q]), r, q) for q, (c, r) in enumerate(zip(costs, ranks, strict=True)) if c is not None)
    return state, cost


def _written(turns: list[dict], codes: list[int], state: int, last: bool) -> tuple[str, list[dict]]:
    """Audit and repaired turns of a chunk that is entered in a state."""
    audit, out = [], []
    at = 0
    for turn in turns:
        for gone in _gone(turn):
            code = CODES[codes[at]]
            at += 1
            audit.append("D" * gone if gone else code)
            if code == "D":
                continue
            if code[0] == "I":
                state = NEXT[state]
                out.append({"role": ROLES[state], "text": ""})
            if code[-1] == "K":
                state = KEEPS[state, turn["role"][:1]]
                out.append({"role": turn["role"], "text": turn["text"]})
            else:
                state = NEXT[state]
                out.append({"role": ROLES[state], "text": turn["text"]})
    for _ in ENDS[state] if last else "":
        state = NEXT[state]
        audit.append("I")
        out.append({"role": ROLES[state], "text": ""})
    return "".join(audit), out


def _gone(turn: dict) -> list[int]:
    """Rows that have to go, for each item of a turn: the copies of a turn that may stay are an item of their own."""
    if turn["fault"] in (BLANK, DUPLICATE):
        return [turn["copies"]]
    return [0, turn["copies"] - 1] if turn["copies"] > 1 else [0]


def _items(turns: list[dict]) -> list[Item]:
    out = []
    for turn in turns:
        initial = turn["role"][:1]
        out += [(initial if initial in ("s", "u", "a") else "", turn["fault"] == CUT, gone) for gone in _gone(turn)]
    return out


#: What a chunk tells of its rows: sums, and the turns and initials at its bounds.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")


class _Chunk:
    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.chars = conv, [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None

    def full(self, most: int) -> bool:
        return len(self.turns) >= most or self.chars >= CHARS

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.counts["illegal"] += copies - 1
        self.last = initial
        if turn is not None:
            self.counts["distinct"] += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault == BLANK:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - (fault != DUPLICATE)
            self.counts["truncated"] += fault == CUT
        self.turns.append({"role": role, "text": text, "copies": copies, "fault": fault})
        self.chars += len(text) + len(role)


_BOUNDS = "low long, high long, first string, last string"
_SUMS = ", ".join(f"{c} long" for c in COUNTS)
_TURN = "role: string, text: string"


def _chunk_schema(kind: str) -> str:
    return f"conv {kind}, part int, chunk long, whole boolean, {_BOUNDS}, {_SUMS}, costs array<long>, ranks array<int>, cost long, audit string, turns array<struct<{_TURN}>>, raw array<struct<{_TURN}, copies: long, fault: int>>"


def _row(c: _Chunk, part: int, chunk: int, whole: bool) -> dict:
    out = {"conv": c.conv, "part": part, "chunk": chunk, "whole": whole, "low": c.low, "high": c.high, "first": c.first, "last": c.last, **c.counts}
    items = _items(c.turns)
    if not whole:
        costs, ranks = _table(items)
        return out | {"costs": costs, "ranks": ranks, "cost": None, "audit": None, "turns": None, "raw": c.turns}
    layer, total, pointers = _run(items, 0)
    state, cost = _end([h and h[0] + total for h in layer], [h and h[1] for h in layer])
    audit, turns = _written(c.turns, _codes(pointers, state), 0, True)
    return out | {"costs": None, "ranks": None, "cost": cost, "audit": audit, "turns": turns, "raw": None}


def _batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 4 * CHARS) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(t["text"]) for t in row.get("turns") or row.get("raw") or ())
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _chunked(schema: pa.Schema, most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, chunk, current, cut = TaskContext.get().partitionId(), 0, None, True
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for r in b.slice(at, 512).to_pylist():
                    if current is not None and r["conv"] != current.conv:
                        yield _row(current, part, chunk, not cut)
                        current, cut, chunk = None, False, chunk + 1
                    elif current is not None and current.full(most):
                        yield _row(current, part, chunk, False)
                        current, cut, chunk = None, True, chunk + 1
                    if current is None:
                        current = _Chunk(r["conv"])
                    current.add(r["turn"], r["role"], r["text"], r["copies"], r["fault"])
        if current is not None:  # the next range may go on with it
            yield _row(current, part, chunk, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    return run


def _paths(chunks: pd.DataFrame) -> pd.DataFrame:
    """The way of a conversation through its chunks: tables in, states at the bounds out. The sums stand with the last chunk."""
    chunks = chunks.sort_values(["part", "chunk"])
    layer, back = [(0, 0), None, None, None], []
    for costs, ranks in zip(chunks["costs"], chunks["ranks"], strict=True):
        new, rank_of = [None] * 4, []
        for q in range(4):
            ways = [(layer[p][0] + int(costs[4 * p + q]), layer[p][1], p) for p in range(4) if layer[p] is not None and costs[4 * p + q] >= 0]
            if ways:
                cost, rank, p = min(ways)
                new[q] = (cost, p)
                rank_of.append((rank, int(ranks[4 * p + q]), q))
        back.append([n and n[1] for n in new])
        place = {q: n for n, (_, _, q) in enumerate(sorted(rank_of))}
        layer = [n and (n[0], place[q]) for q, n in enumerate(new)]
    state, cost = _end([h and h[0] for h in layer], [h and h[1] for h in layer])
    ways = []
    for parents in reversed(back):
        ways.append((parents[state], state))
        state = parents[state]
    ways.reverse()
    out = chunks[["part", "chunk"]].copy()
    out["entry"], out["exit"] = [w[0] for w in ways], [w[1] for w in ways]
    out["final"] = [False] * (len(out) - 1) + [True]
    sums = {c: int(chunks[c].sum()) for c in COUNTS}
    firsts, lasts = chunks["first"].tolist(), chunks["last"].tolist()
    sums["illegal"] += sum(x + y not in ("su", "ua", "au") for x, y in zip(lasts, firsts[1:]))
    spans = [(int(x), int(y)) for x, y in zip(chunks["low"], chunks["high"]) if not pd.isna(x)]
    sums["distinct"] -= sum(x[1] == y[0] for x, y in zip(spans, spans[1:]))  # a turn that a bound cuts
    for name, value in (sums | {"cost": cost, "low": spans[0][0] if spans else None, "high": spans[-1][1] if spans else None}).items():
        out[name] = pd.array([None] * (len(out) - 1) + [value], dtype="Int64")
    return out


def _pieces(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                _, _, pointers = _run(_items(r["raw"]), r["entry"])
                audit, turns = _written(r["raw"], _codes(pointers, r["exit"]), r["entry"], r["final"])
                yield {n: r[n] for n in schema.names if n in r} | {"audit": audit, "turns": turns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    return run


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text of a table's rows with planted faults by crc32(`conv:turn`) modulo 20.

    0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats it, 4 makes its role user. A null id or turn is one space in
    that key, a null role or text becomes one space; the turn itself stays null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    known = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), fault.alias("fault")).where("fault <> 0")
    altered = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return known.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), altered.alias("text"), times.alias("one")).drop("one")


def _faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, fault: one row for equal rows. copies counts them; fault is the first one's."""
    digest = F.sha2(F.to_json(F.struct("role", "text")), 256)
    once = rows.withColumn("digest", digest).groupBy("conv", "turn", "role", "text", "digest").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # turns seen in more than one place of a conversation: few, and narrow
    seen = rows.select("conv", "turn", digest.alias("digest")).groupBy("conv", "digest").agg(F.min(place).alias("at"), F.max(place).alias("until")).where("at <> until")
    seen = seen.select(F.col("conv").alias("in_conv"), F.col("digest").alias("of"), "at")
    joined = once.join(seen, F.col("conv").eqNullSafe(F.col("in_conv")) & (F.col("digest") == F.col("of")), "left")
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    earlier: Column = F.col("at").isNotNull() & ~F.col("at").eqNullSafe(place)
    fault = F.when(shown == "", BLANK).when(earlier, DUPLICATE).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    return joined.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def repaired(rows: DataFrame, conv: str, turn: str, role: str, text: str, *, rows_a_chunk: int = ROWS) -> DataFrame:
    """Pieces of repaired conversations: conv, part, chunk, turns (role, text), audit, and with the last piece of each the sums.

    Conversations are a column's values, a null being one; rows stand by turn (nulls first), rows of equal turn by role and text. A null role or
    text counts as one space. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (last visible character not `.!?`).
    Keeping a row costs 0, a user or assistant role 1, deletion 2 (which blank and duplicate rows have to suffer), an inserted empty
    turn 5; a truncated row that stays adds 5. Roles end up as `(s?(ua)+)?` by their initials; of the cheapest ways the one
    of the ASCII-least audit is taken. Sums: blank, duplicate, truncated, illegal (neighbours whose initials are not su, ua or
    au), gaps (turns missing between the least and the largest), cost. Most conversations are one piece; in order of part and chunk,
    the pieces' turns and audits make the conversation. An empty table has no pieces; other columns play no part.

    Equal rows are counted before they are shuffled; a conversation of any length is spread over tasks by ranges of its turns.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    known = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    kind = known.schema["conv"].dataType.simpleString()
    ranged = _faults(known).withColumn("head", F.substring("text", 1, 32)).repartitionByRange("conv", "turn", "role", "head").drop("head")
    ordered = ranged.sortWithinPartitions("conv", "turn", "role", "text")
    spark = rows.sparkSession
    schema = _chunk_schema(kind)
    chunks = written(ordered.mapInArrow(_chunked(_arrow(spark, schema), rows_a_chunk), schema))
    narrow = ["conv", "part", "chunk", "low", "high", "first", "last", *COUNTS, "costs", "ranks"]
    way = "part int, chunk long, entry int, exit int, final boolean, cost long, low long, high long, " + _SUMS
    ways = chunks.where("NOT whole").select(narrow).groupBy("conv").applyInPandas(_paths, way)
    piece = f"conv {kind}, part int, chunk long, final boolean, low long, high long, {_SUMS}, cost long, audit string, turns array<struct<{_TURN}>>"
    cut = chunks.where("NOT whole").select("conv", "part", "chunk", "raw").join(ways, ["part", "chunk"])
    pieces = cut.mapInArrow(_pieces(_arrow(spark, piece)), piece).withColumn("whole", F.lit(False))
    whole = chunks.where("whole").withColumn("final", F.lit(True)).select(pieces.columns)
    gaps = F.when(F.col("final"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)))
    return whole.unionByName(pieces).select("conv", "part", "chunk", "whole", "final", "turns", "audit", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def turns(pieces: DataFrame) -> DataFrame:
    """conv, part, chunk, place, role, text: a row for each repaired turn, in order of part, chunk and place."""
    return pieces.select("conv", "part", "chunk", F.posexplode("turns").alias("place", "turn")).select("conv", "part", "chunk", "place", "turn.role", "turn.text")


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, began = hashlib.sha256(), [], False
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                for t in r["turns"]:
                    digest.update(f"{chr(10) if began else ''}{t['role']}:{t['text']}".encode())
                    began = True
                audit.append(r["audit"])
                if r["final"]:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in ("conv", *_SUMMARY)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
                    digest, audit, began = hashlib.sha256(), [], False

    return run


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv, the sums, audit, repaired_sha256 (of the turns as `role:text`, joined by newlines).

    A digest reads its conversation in order: pieces of those that were cut meet in one task each, which holds a piece at a time.
    """
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in _SUMMARY) + ", audit string, repaired_sha256 string"
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").select("conv", *_SUMMARY, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    cut = pieces.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    return whole.unionByName(cut.mapInArrow(_streamed(_arrow(pieces.sparkSession, schema)), schema))
