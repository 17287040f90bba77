"""Cheapest edits that bring a sequence of turns into the form ``(s?(ua)+)?``.

Four states tell what a conversation may go on with: nothing yet, after the system
turn, after a user turn, after an assistant turn.  A *step* is what one row, or a whole
stretch of rows, makes of them: for each state before and state after the least cost,
and the place of its edits among the equally long stretches that leave the same state.

Edits are letters: K keep (0), R give the role that is due (1), D delete (2), I insert
an empty turn of the role that is due (5); a truncated row that stays costs 5 more, a
blank or repeated one has to go.  A letter leads from a state to exactly one other, so
two different strings from one state are never a beginning of each other if inserts are
counted to the row behind them.  Therefore the order of two strings is that of the
parts before a cut unless these are equal, and with it the four best strings up to a
row can be kept in order without being written down: ``(cost, rank)`` for each state.

``crossings`` is Hirschberg's divide and conquer: the costs forward to the middle and
backward from the end meet there, the cheapest state with the least string is where the
solution passes, and both halves are solved the same way.  It needs memory in proportion
to the rows, never a table of states by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
FAR = 1 << 60
FINE, TRUNCATED, BLANK, REPEATED = range(4)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
# what has to be added after the last row, by state
END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Vector = tuple[tuple[int, int], ...]


def due(state: int) -> str:
    """Initial of the role that a rerole or an insert gives."""
    return "a" if state == USER else "u"


def after(state: int, initial: str) -> int | None:
    """State after a row with this initial, if it may stand here."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


class Step:
    """Least ``(cost, order)`` from state to state; what it makes of a vector is
    remembered, since only few differences of costs occur."""

    __slots__ = ("cells", "_ahead", "_back")

    def __init__(self, cells: Sequence[Sequence[tuple | None]]):
        self.cells = cells
        self._ahead: dict[Vector, tuple[int, Vector]] = {}
        self._back: dict[tuple[int, ...], tuple[int, tuple[int, ...]]] = {}

    def ahead(self, vector: Vector) -> tuple[int, Vector]:
        """Least cost, and cost above it and rank of each state after the step."""
        known = self._ahead.get(vector)
        if known is None:
            best: dict[int, tuple] = {}
            for x, (cost, rank) in enumerate(vector):
                for y, cell in enumerate(self.cells[x]):
                    if cost < FAR and cell is not None:
                        found = (cost + cell[0], rank, cell[1])
                        if y not in best or found < best[y]:
                            best[y] = found
            least = min((b[0] for b in best.values()), default=0)
            order = sorted(best, key=lambda y: best[y][1:])
            known = least, tuple(
                (best[y][0] - least, order.index(y)) if y in best else (FAR, len(order))
                for y in STATES
            )
            self._ahead[vector] = known
        return known

    def back(self, costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """Least cost, and cost above it from each state before the step."""
        known = self._back.get(costs)
        if known is None:
            whole = [
                min((c[0] + costs[y] for y, c in enumerate(row) if c is not None), default=FAR)
                for row in self.cells
            ]
            least = min(whole)
            known = least, tuple(FAR if w >= FAR else w - least for w in whole)
            self._back[costs] = known
        return known


def _row_step(initial: str, fault: int) -> Step:
    cells: list[list] = [[None] * len(STATES) for _ in STATES]
    for x in STATES:
        # a second insert in one place never pays: a delete is cheaper
        for prefix in ("", "I"):
            at = after(x, due(x)) if prefix else x
            options = [("D", at, 0)]
            if fault in (FINE, TRUNCATED):
                late = TRUNCATED_COST if fault == TRUNCATED else 0
                options += [("K", after(at, initial), late), ("R", after(at, due(at)), late)]
            for letter, y, more in options:
                if y is not None:
                    found = (sum(map(COST.get, prefix + letter)) + more, prefix + letter)
                    if cells[x][y] is None or found < cells[x][y]:
                        cells[x][y] = found
    return Step(cells)


_ROW_STEPS = {(i, f): _row_step(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def row_step(initial: str, fault: int) -> Step:
    return _ROW_STEPS[initial if initial in ("s", "u", "a") else "", fault]


def _only(state: int) -> Vector:
    return tuple((0, 0) if s == state else (FAR, 1) for s in STATES)


def forward(steps: Sequence[Step], entry: int) -> list[tuple[int, int]]:
    """Cost and rank of each state after the steps."""
    total, vector = 0, _only(entry)
    for step in steps:
        least, vector = step.ahead(vector)
        total += least
    return [(total + c if c < FAR else FAR, r) for c, r in vector]


def backward(steps: Sequence[Step], leave: int) -> list[int]:
    """Cost from each state before the steps to ``leave`` after them."""
    total, costs = 0, tuple(0 if s == leave else FAR for s in STATES)
    for step in reversed(steps):
        least, costs = step.back(costs)
        total += least
    return [total + c if c < FAR else FAR for c in costs]


def whole(steps: Sequence[Step]) -> list[list[tuple[int, int]]]:
    """The steps as one: ``(cost, rank)`` by state before and state after."""
    return [forward(steps, x) for x in STATES]


def stretch(cells: Sequence[Sequence[tuple[int, int]]]) -> Step:
    """The step of ``whole``."""
    return Step([[c if c[0] < FAR else None for c in row] for row in cells])


def last_state(reached: Sequence[tuple[int, int]]) -> tuple[int, int]:
    """Least cost of a whole conversation and the state after its last row."""
    total, _, state = min(
        (cost + COST["I"] * len(END[s]), rank, s) for s, (cost, rank) in enumerate(reached)
    )
    return total, state


def crossings(steps: Sequence[Step], entry: int, leave: int) -> list[int]:
    """States between the steps, on the cheapest way with the least string."""
    if len(steps) < 2:
        return []
    middle = len(steps) // 2
    first, second = steps[:middle], steps[middle:]
    reached, rest = forward(first, entry), backward(second, leave)
    at = min((reached[s][0] + rest[s], reached[s][1], s) for s in STATES)[2]
    return crossings(first, entry, at) + [at] + crossings(second, at, leave)


def edits(steps: Sequence[Step], entry: int, leave: int) -> str:
    """The letters of row steps on that way."""
    states = [entry, *crossings(steps, entry, leave), leave]
    return "".join(step.cells[x][y][1] for step, x, y in zip(steps, states, states[1:]))
