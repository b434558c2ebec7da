"""Regular expressions as one deterministic automaton over bytes.

Literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}`` are
understood.  Expressions become a nondeterministic automaton, that a deterministic one by subset
construction, and that the smallest one by refining a partition of its states.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": 10, "r": 13, "t": 9}


class _Parser:
    """Parses into nested tuples: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def parse(self):
        out = self.either()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return out

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.one()
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        c = self.peek()
        self.i += 1
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.s.index("}", self.i)
        least, comma, most = self.s[self.i : end].partition(",")
        self.i = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
            if c in _ESCAPES:
                return _ESCAPES[c]
            if c.isalnum():
                raise ValueError(f"\\{c} is not understood")
        if ord(c) > 127:
            raise ValueError("rules are over ASCII")
        return ord(c)

    def one(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            out = self.either()
            if self.peek() != ")":
                raise ValueError(f"no ) in {self.s!r}")
            self.i += 1
            return out
        if c == "[":
            return ("set", self.members())
        if c in "?*+{":
            raise ValueError(f"nothing to repeat at {self.i} in {self.s!r}")
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.byte()]))

    def members(self) -> frozenset[int]:
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                out.update(range(low, self.byte() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(range(256)) - out if negated else frozenset(out)


class _Steps:
    """A nondeterministic automaton with empty steps."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            at = self.state()
            self.empty[start].append(at)
            self.on[at] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                branch = self.state()
                self.empty[start].append(branch)
                self.empty[self.add(part, branch)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.add(copy.copy(part), loop)].append(loop)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    #: The next state by state and byte; ``accept`` has a bit for each rule that ends in a state.
    next: np.ndarray
    accept: np.ndarray
    start: int
    #: The state from which nothing is accepted any more, or -1.
    dead: int

    def __post_init__(self):
        self.flat = np.ascontiguousarray(self.next).reshape(-1)
        self._rows = None

    def rows(self) -> tuple[list[list[int]], list[bool], list[bool]]:
        if self._rows is None:
            first = [bool(x) for x in self.next[self.start] != self.dead]
            self._rows = (self.next.tolist(), [bool(a) for a in self.accept], first)
        return self._rows

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "flat")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def longest(self, data: bytes, start: int, stop: int | None = None) -> int:
        """Where the longest match from ``start`` ends, or -1."""
        rows, accept, _ = self.rows()
        state, dead, end = self.start, self.dead, -1
        if accept[state]:
            end = start
        for i in range(start, len(data) if stop is None else stop):
            state = rows[state][data[i]]
            if state == dead:
                break
            if accept[state]:
                end = i + 1
        return end

    def search(self, data: bytes, at: int) -> tuple[int, int] | None:
        """The leftmost longest match that isn't empty, from ``at`` on."""
        _, _, first = self.rows()
        for i in range(at, len(data)):
            if first[data[i]]:
                end = self.longest(data, i)
                if end > i:
                    return i, end
        return None


def compile_rules(patterns: list[str], anywhere: bool = False) -> Automaton:
    """One automaton for all patterns; ``anywhere``: it accepts where a match ends that began anywhere."""
    steps = _Steps()
    root = steps.state()
    ends = {}
    for i, pattern in enumerate(patterns):
        branch = steps.state()
        steps.empty[root].append(branch)
        ends[steps.add(_Parser(pattern).parse(), branch)] = 1 << i

    # Bytes that no rule tells apart share a column.
    sets = {on[0] for on in steps.on if on}
    classes: dict[tuple, list[int]] = {}
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = list(classes.values())
    has = [[on is not None and c[0] in on[0] for c in columns] for on in steps.on]

    begin = steps.closure([root])
    number, todo, table = {begin: 0}, [begin], []
    while todo:
        now = todo.pop(0)
        row = []
        for k in range(len(columns)):
            to = {steps.on[s][1] for s in now if has[s][k]}
            target = steps.closure(to) | begin if anywhere else steps.closure(to)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        table.append(row)
    accept = np.zeros(len(number), np.int64)
    for states, i in number.items():
        for s in states:
            accept[i] |= ends.get(s, 0)

    moves = np.array(table, np.int64)
    # States are told apart by what they accept, and then by where they lead, until nothing changes.
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block[:, None], block[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    size = int(block.max()) + 1
    some = np.zeros(size, np.int64)
    some[block] = np.arange(len(block))
    small = block[moves[some]]
    wide = np.zeros((size, 256), np.int32 if size > 32_767 else np.int16)
    for k, members in enumerate(columns):
        wide[:, members] = small[:, [k]]
    kept = accept[some]
    stuck = np.flatnonzero((small == np.arange(size)[:, None]).all(axis=1) & (kept == 0))
    return Automaton(wide, kept, int(block[0]), int(stuck[0]) if len(stuck) else -1)
