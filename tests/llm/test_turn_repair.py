import hashlib
import os
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from scholia.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Cost, audit and repaired turns by carrying every state's audit and turns as they are, any number of insertions before a row."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(4):
            for last, (cost, audit, turns) in list(states.items()):
                for c in follow[last]:
                    if c != "s":
                        new = (cost + 5, audit + "I", [*turns, (full[c], "")])
                        if c not in states or new[:2] < states[c][:2]:
                            states[c] = new
        return states

    states = {"": (0, "", [])}
    for role, text, fault in rows:
        # all ways with up to three insertions, kept apart by audit, since an audit may not be cut short before rows are compared
        ways = [(last, cost, audit, turns) for last, (cost, audit, turns) in states.items()]
        for _ in range(3):
            ways += [(c, cost + 5, audit + "I", [*turns, (full[c], "")]) for last, cost, audit, turns in list(ways) for c in follow[last] if c != "s"]
        new = {}
        for last, cost, audit, turns in ways:
            options = [(last, cost + 2, audit + "D", turns)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in follow[last]:
                    options.append((role[:1], cost + more, audit + "K", [*turns, (role, text)]))
                options += [(c, cost + 1 + more, audit + "R", [*turns, (full[c], text)]) for c in follow[last] if c != "s"]
            for state, *held in options:
                if state not in new or tuple(held[:2]) < new[state][:2]:
                    new[state] = tuple(held)
        states = new
    ends = inserted(dict(states))
    return min((ends[e] for e in ("", "a") if e in ends), key=lambda x: x[:2])


def brute(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)} of damaged rows."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in groups.items():
        own.sort()
        seen, told = set(), []
        for _, _, role, text in own:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {t for known, t, _, _ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(told, told[1:]))
        cost, audit, repaired = cheapest(told)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *(sum(f == k for _, _, f in told) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def got(df):
    rows = df.collect()
    out = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    return turn_repair.digests(turn_repair.repaired(df, "conv", "turn", "role", "text"))


def made(rng, n, most=9):
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "One. Two", "Fine. \t", "Ü."]
    out = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(1, most)):
            out.append((conv, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "sys", "users"]), rng.choice(texts)))
    return out


def test_every_short_conversation_is_cheapest():
    """All sequences of up to three rows of each kind of role and fault, against the plain search."""
    kinds = [(role, fault) for role in ("system", "user", "assistant", "x") for fault in (None, "truncated", "blank")]
    faults = {None: turn_repair.NONE, "truncated": turn_repair.CUT, "blank": turn_repair.BLANK}
    for n in (1, 2, 3):
        for rows in product(kinds, repeat=n):
            turns = [{"role": r, "text": f"t{i}", "copies": 1, "fault": faults[f]} for i, (r, f) in enumerate(rows)]
            layer, total, pointers = turn_repair._run(turn_repair._items(turns), 0)
            state, cost = turn_repair._end([h and h[0] + total for h in layer], [h and h[1] for h in layer])
            audit, out = turn_repair._written(turns, turn_repair._codes(pointers, state), 0, True)
            want = cheapest([(r, f"t{i}", f) for i, (r, f) in enumerate(rows)])
            assert (cost, audit, [(t["role"], t["text"]) for t in out]) == want, rows


def test_equals_brute_force(spark):
    rows = made(random.Random(1), 120)
    assert got(repaired(spark, rows)) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_chunks_compose(spark, size):
    """Conversations cut into chunks of a few rows: ranks, costs and counts at the bounds."""
    rows = made(random.Random(size), 40, 30)
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    assert got(turn_repair.digests(turn_repair.repaired(df, "conv", "turn", "role", "text", rows_a_chunk=size))) == brute(rows)


def test_hot_conversation_and_repeated_rows(spark):
    rng = random.Random(7)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "Go on!", f"t{i}."])) for i in range(1500)]
    rows += [(2, 4, "user", "again.")] * 5000 + [(3, None, "assistant", "x")] * 3
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(7)
    pieces = turn_repair.repaired(df, "conv", "turn", "role", "text")
    assert got(turn_repair.digests(pieces)) == brute(rows)
    told = turn_repair.turns(pieces).where("conv = 1").orderBy("part", "chunk", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in told))


def test_nulls_empty_and_other_columns(spark):
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "user", None), (1, None, "user", "Hi."), (1, None, None, "Yes."), (2, 1, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv long, turn long, role string, text string, fault int, digest string")
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(turn_repair.digests(turn_repair.repaired(df, "conv", "turn", "role", "text"))) == brute(filled)
    assert got(turn_repair.digests(turn_repair.repaired(df.limit(0), "conv", "turn", "role", "text"))) == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows))
    df = queries.op13_turn_repair(spark, SF)
    found = got(df.withColumnRenamed("conv_id", "conv"))
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        assert row == want.get(conv, (0, 0, 0, 0, 0, 0, "", EMPTY))


def test_query_over_nulls_and_dropped_conversations(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (None, None, None, None), (None, 1, "user", "Stays."), (5, None, None, "Hm."), (5, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = got(queries.op13_turn_repair(spark, str(tmp_path)).withColumnRenamed("conv_id", "conv"))
    want = brute(damage(rows))
    assert found == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", EMPTY)) for c in {r[0] for r in rows}}
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)
