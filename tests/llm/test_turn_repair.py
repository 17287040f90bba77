"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from stratavec.llm import turn_grammar as G
from stratavec.llm import turn_repair


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost and least string, from whole strings of every state."""
    state = {G.START: (0, "")}
    for initial, fault in [*rows, (None, None)]:
        # inserts, as many as there are ways to
        queue = list(state.items())
        while queue:
            s, (cost, text) = queue.pop()
            to, found = G.after(s, G.due(s)), (cost + 5, text + "I")
            if cost < 60 and (to not in state or found < state[to]):
                state[to] = found
                queue.append((to, found))
        if initial is None:
            return min(state[s] for s in (G.START, G.ASSISTANT) if s in state)
        new: dict[int, tuple[int, str]] = {}
        for s, (cost, text) in state.items():
            options = [(s, cost + 2, "D")]
            if fault in (G.FINE, G.TRUNCATED):
                late = 5 * (fault == G.TRUNCATED)
                options += [(G.after(s, initial), cost + late, "K")]
                options += [(G.after(s, r), cost + late + 1, "R") for r in "ua"]
            for to, c, letter in options:
                if to is not None and (to not in new or (c, text + letter) < new[to]):
                    new[to] = (c, text + letter)
        state = new


def test_grammar():
    rnd = random.Random(1)
    for n in list(range(7)) * 150 + [40] * 60:
        rows = [(rnd.choice("suaux"), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        steps = [G.row_step(*r) for r in rows]
        cost, leave = G.last_state(G.forward(steps, G.START))
        audit = G.edits(steps, G.START, leave) + G.END[leave]
        assert (cost, audit) == cheapest(rows), rows
        # cut into pieces, the same
        cuts = sorted(rnd.sample(range(n + 1), min(n, 3)))
        pieces = [steps[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        nodes = [G.stretch(G.whole(p)) for p in pieces]
        assert G.last_state(G.forward(nodes, G.START)) == (cost, leave)
        states = [G.START, *G.crossings(nodes, G.START, leave), leave]
        parts = [G.edits(p, x, y) if p else "" for p, x, y in zip(pieces, states, states[1:])]
        assert "".join(parts) + G.END[leave] == audit


def plain(conversations):
    """Report rows by reading each conversation as a whole."""
    out = {}
    space = lambda x: " " if x is None else str(x)
    for conv_id in {c[0] for c in conversations}:
        rows = []
        for _, turn, role, text in [c for c in conversations if c[0] == conv_id]:
            role, text = space(role), space(text)
            k = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            if not visible:
                faults.append(G.BLANK)
            elif (role, text) in seen:
                faults.append(G.REPEATED)
            else:
                faults.append(G.FINE if visible[-1] in ".!?" else G.TRUNCATED)
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
        roles, state, at = [], G.START, iter(rows)
        for letter in audit:
            row = None if letter == "I" else next(at)
            if letter == "D":
                continue
            due = {"u": "user", "a": "assistant"}[G.due(state)]
            role = row[1] if letter == "K" else due
            roles.append(f"{role}:{row[2] if row else ''}")
            state = G.after(state, role[:1])
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[faults.count(f) for f in (G.BLANK, G.REPEATED, G.TRUNCATED)],
            sum(p not in {"su", "ua", "au"} for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(roles).encode()).hexdigest(),
        )
    return out


def conversations_of(seed: int, n: int, longest: int = 12):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "\x1c", "é 🙂?", "Yes.", "a. b", "x" * 300 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "", "tool", "u", None]
    out = []
    for conv_id in range(n):
        for turn in range(rnd.randint(1, longest)):
            # texts are mostly different
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"{rnd.random()}{rnd.choice('.x')}"
            out.append((conv_id, rnd.choice([turn, turn, turn, 3, 2 * turn]), rnd.choice(roles), text))
    out += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (7, None, "user", None)]
    out += [(n, 0, "user", "a.")] * 5 + [(n + 1, None, None, None)] * 3
    return out


SCHEMA = "conv_id long, turn long, role string, text string, edits string"


@pytest.mark.parametrize("bits", [(11, 8), (1, 1)])
def test_report(spark, monkeypatch, bits):
    # with (1, 1) two rows are a block and two nodes have a parent
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(turn_repair, "FAN_BITS", bits[1])
    rows = conversations_of(4, 60) + [
        (100, t, "user" if t % 3 else "assistant", f"{t}{'.' if t % 7 else ''}") for t in range(90)
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair_report(frame).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == want[key], key
    turns = turn_repair.repaired_turns(frame).collect()
    for key in want:
        mine = sorted((r["place"], f"{r['role']}:{r['text']}") for r in turns if r["conv_id"] == key)
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == want[key][-1]


def test_one_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t} text.") for t in range(30_000)]
    rows += [(1, 5, "user", "same.")] * 3000 + [(2, 0, "user", "x.")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair_report(frame).collect()}
    assert got == plain(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_report(frame).collect() == []
    dropped = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "a.", "z")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in turn_repair.repair_report(frame).collect()] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", nothing)
    ]
