"""Regular expressions of several rules compiled into one deterministic automaton over bytes.

Each rule's expression becomes a nondeterministic automaton; subset construction follows the rules' searches side by side,
leftmost and greedy, each beginning anew where its last match ended; equal states are merged. What is left is an array of
transitions. A state tells which rules' matches ended right before the byte that led to it.

Expressions have characters below 128, [classes] with ranges, (groups|of|choices), ? * + {n,} and \\ before a character.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: A byte that no UTF-8 text has; it stands after each text.
END = 0xFF


class Rule(NamedTuple):
    """A match is head then tail; it counts if the tail has `least` characters."""

    kind: str
    head: str
    tail: str
    least: int


def _parse(pattern: str) -> tuple:
    """The expression as nested (set, bytes), (cat, parts), (alt, choices), (rep, part, least, bounded by one)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def choices() -> tuple:
        found = [sequence()]
        while peek() == "|":
            take()
            found.append(sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence() -> tuple:
        found = []
        while peek() not in ("", "|", ")"):
            part = one()
            while peek() and peek() in "?*+{":
                mark = take()
                if mark == "{":
                    n = ""
                    while peek() != ",":
                        n += take()
                    take(), take()
                    part = ("rep", part, int(n), False)
                else:
                    part = ("rep", part, int(mark == "+"), mark == "?")
            found.append(part)
        return ("cat", found)

    def one() -> tuple:
        c = take()
        if c == "(":
            inner = choices()
            take()
            return inner
        if c == "[":
            held = set()
            while peek() != "]":
                low = take() if peek() != "\\" else (take(), take())[1]
                if peek() == "-" and pattern[at + 1] != "]":
                    take()
                    held.update(range(ord(low), ord(take()) + 1))
                else:
                    held.add(ord(low))
            take()
            return ("set", frozenset(held))
        return ("set", frozenset([ord(take() if c == "\\" else c)]))

    return choices()


def _reversed(node: tuple) -> tuple:
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


class _States:
    """A nondeterministic automaton: state 0 accepts, others go on by a set of bytes or without any."""

    def __init__(self, node: tuple) -> None:
        self.reads: list[tuple[frozenset, int] | None] = [None]
        self.free: list[list[int]] = [[]]
        self.start = self.closure([self._add(node, 0)])

    def _new(self, reads: tuple | None, free: list[int]) -> int:
        self.reads.append(reads)
        self.free.append(free)
        return len(self.reads) - 1

    def _add(self, node: tuple, to: int) -> int:
        if node[0] == "set":
            return self._new((node[1], to), [])
        if node[0] == "cat":
            for part in reversed(node[1]):
                to = self._add(part, to)
            return to
        if node[0] == "alt":
            return self._new(None, [self._add(part, to) for part in node[1]])
        _, part, least, once = node
        if once:
            to = self._new(None, [self._add(part, to), to])
        else:
            loop = self._new(None, [to])
            self.free[loop].append(self._add(part, loop))
            to = loop
        for _ in range(least):
            to = self._add(part, to)
        return to

    def closure(self, states: list[int]) -> frozenset:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(s for s in found if s == 0 or self.reads[s])

    def move(self, states: frozenset, byte: int) -> frozenset:
        return self.closure([self.reads[s][1] for s in states if s and byte in self.reads[s][0]])


class Anchored:
    """The longest match from a place on, forwards or backwards."""

    def __init__(self, pattern: str, backwards: bool = False) -> None:
        self.states = _States(_reversed(_parse(pattern)) if backwards else _parse(pattern))
        self.step = -1 if backwards else 1
        self.known: dict[tuple[frozenset, int], frozenset] = {}

    def longest(self, data: bytes, at: int, bound: int) -> int:
        """Where the longest match between `at` and `bound` ends, or `at` where there is none."""
        now, best = self.states.start, at
        while now and at != bound:
            key = now, data[at if self.step > 0 else at - 1]
            now = self.known.get(key)
            if now is None:
                now = self.known[key] = self.states.move(*key)
            at += self.step
            if 0 in now:
                best = at
        return best


class _Search:
    """One rule's search as subsets: the candidates for the leftmost match, each the states that its start has led to."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.states = _States(_parse(f"{rule.head}{rule.tail}"))
        self.known: dict[tuple, tuple] = {}

    def move(self, found: tuple, byte: int) -> tuple[tuple, bool]:
        """The candidates after one more byte, and whether a match ended before it."""
        key = found, byte
        if key not in self.known:
            self.known[key] = self._move(found, byte)
        return self.known[key]

    def _move(self, found: tuple, byte: int) -> tuple[tuple, bool]:
        states = self.states
        if found and 0 in found[0]:
            if further := states.move(found[0], byte):
                if 0 not in further:
                    raise ValueError(f"a match of {self.rule.kind} can run on without ending well")
                return (further,), False
            fresh = states.move(states.start, byte)
            return ((fresh,) if fresh else ()), True
        moved, seen = [], frozenset()
        for states_of_one in (*found, states.start):
            if left := states.move(states_of_one, byte) - seen:
                if 0 in left and moved:
                    raise ValueError(f"two matches of {self.rule.kind} can overlap so that the later one ends first")
                moved.append(left)
                seen |= left
                if 0 in left:
                    break
        return tuple(moved), False


class Automaton:
    """All rules' searches in one array of transitions."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        searches = [_Search(r) for r in rules]
        sets = [reads[0] for s in searches for reads in s.states.reads if reads]
        # Bytes that no expression tells apart are one class.
        signs = np.array([[byte in held for held in sets] for byte in range(256)])
        _, first, classes = np.unique(signs, axis=0, return_index=True, return_inverse=True)
        root = (((),) * len(rules), 0)
        number, todo, rows = {root: 0}, [root], []
        for found, _ in todo:
            row = []
            for byte in first.tolist():
                moves = [s.move(f, byte) for s, f in zip(searches, found)]
                to = tuple(m[0] for m in moves), sum(1 << k for k, m in enumerate(moves) if m[1])
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        self.subsets = len(rows)
        self._minimise(np.array(rows), np.array([ended for _, ended in todo]), classes.reshape(-1).astype(np.int32))

    def _minimise(self, to: np.ndarray, ended: np.ndarray, classes: np.ndarray) -> None:
        """Merges states that end the same matches after any bytes; those that end one get the last numbers."""
        block, count = ended, len(np.unique(ended))
        while True:
            _, first, block = np.unique(np.column_stack([block, block[to]]), axis=0, return_index=True, return_inverse=True)
            block = block.reshape(-1)
            if len(first) == count:
                break
            count = len(first)
        order = np.argsort(ended[first] > 0, kind="stable")
        place = np.empty(count, np.int32)
        place[order] = np.arange(count)
        self.width = int(classes.max()) + 1
        self.classes = classes
        self.next = (place[block[to[first[order]]]] * self.width).astype(np.int32).reshape(-1)
        self.ended = ended[first[order]]
        self.loud = int((self.ended == 0).sum()) * self.width
        self.root = int(place[block[0]]) * self.width

    def ends(self, data: np.ndarray, lanes: int = 4096, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Where matches end in `data`, and whose, as bits. Each text in it, the last one too, is followed by END.

        The bytes are cut into lanes which are read side by side, each byte once, as if nothing stood before a lane. Then
        those lanes that begin within something are read again, until they meet the states that they had.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = max(1, min(lanes, len(data) // lane))
        steps = -(-len(data) // lanes)
        padded = np.full(lanes * steps, END, np.uint8)
        padded[: len(data)] = data
        read = np.ascontiguousarray(self.classes[padded].reshape(lanes, steps).T)
        trace = np.empty((steps, lanes), np.int32)
        begun = np.full(lanes, self.root, np.int32)
        now = begun
        for i in range(steps):
            now = self.next[now + read[i]]
            trace[i] = now
        while True:
            right = np.concatenate([begun[:1], trace[-1, :-1]])
            wrong = np.flatnonzero(right != begun)
            if not len(wrong):
                break
            begun, now = right, right[wrong]
            for i in range(steps):
                now = self.next[now + read[i, wrong]]
                differs = now != trace[i, wrong]
                if not differs.any():
                    break
                trace[i, wrong] = now
        step, of = np.nonzero(trace >= self.loud)
        at = of.astype(np.int64) * steps + step
        order = np.argsort(at, kind="stable")
        return at[order], self.ended[trace[step, of][order] // self.width]


@lru_cache(8)
def compiled(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)
