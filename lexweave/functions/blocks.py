"""Matching blocks of two sequences: the longest common run, then the same on both sides of it, and so on.

Of several longest runs the one that begins first in the left sequence counts, then the first in the right one. In a right
sequence of 200 or more, elements that make up over a hundredth of it are common: no run begins at them or has
them inside, but one that is found grows over them.

Two sequences with few pairs of equal elements have all their runs found at once, by diagonals, and each segment picks the
longest of those in it. With more pairs, a short segment is searched by extending runs position by position, which takes as many steps as there are
pairs in it, and one with very many pairs by length: runs of a length are named by exact
numbers, made by doubling, so whether there is a common one is an intersection, and the longest is found by bisection. Memory
stays linear in the sequences, whatever they hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

#: Segments with more pairs of equal elements than this are searched by length.
MANY_PAIRS = 200_000
#: So many runs or fewer are looked at one by one.
FEW_RUNS = 40
#: A right sequence from this size on has common elements: those that come more often than size // 100 + 1 times.
COMMON_FROM = 200


def coded(left: Sequence[str], right: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences with equal elements as equal numbers."""
    if isinstance(left, str) and isinstance(right, str):
        both = np.frombuffer((left + right).encode("utf-32-le"), np.uint32)
    else:
        numbers: dict[str, int] = {}
        both = np.array([numbers.setdefault(x, len(numbers)) for x in (*left, *right)], np.int64)
    _, code = np.unique(both, return_inverse=True)
    code = code.reshape(-1).astype(np.int64)
    return code[: len(left)], code[len(left) :]


class _Pair:
    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left.tolist(), right.tolist()
        kinds = int(max(left.max(initial=-1), right.max(initial=-1))) + 1
        often = np.bincount(right, minlength=kinds)
        usable = often > 0
        if len(right) >= COMMON_FROM:
            usable &= often <= len(right) // 100 + 1
        self.pairs = np.concatenate([[0], np.cumsum(np.where(usable[left], often[left], 0))])
        self.codes, self.sizes = (left, right), (len(left), len(right))
        self.usable = usable
        self.names: list[np.ndarray] | None = None
        self.places: dict[int, list[int]] | None = None

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All runs of usable elements that can't be lengthened: begins in left and right, and sizes; as many as pairs at most."""
        left, right = self.codes
        order = np.argsort(right, kind="stable")
        some = np.flatnonzero(self.usable[left])
        first, count = np.searchsorted(right[order], left[some]), np.diff(self.pairs)[some]
        i = np.repeat(some, count)
        j = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(i))]
        # By diagonals, and along each; neighbours there are one apart.
        width = self.sizes[0] + 1
        key = np.sort((i - j + self.sizes[1]) * width + i)
        begins = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        i = key[begins] % width
        return i, i - key[begins] // width + self.sizes[1], np.diff(np.append(begins, len(key)))

    def longest(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
        """The longest run of usable elements in left[a:b] and right[c:d]: its begins and size."""
        return (self._by_length if self.pairs[b] - self.pairs[a] > MANY_PAIRS else self._by_place)(a, b, c, d)

    def _by_place(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
        if self.places is None:
            self.places = {}
            for j in np.flatnonzero(self.usable[self.codes[1]]).tolist():
                self.places.setdefault(self.right[j], []).append(j)
            self.some = np.flatnonzero(self.usable[self.codes[0]]).tolist()
        best_i, best_j, best = a, c, 0
        left, places, runs, last = self.left, self.places, {}, -2
        # Only elements that can be in a run are looked at; a gap between two ends all runs.
        for i in self.some[bisect_left(self.some, a) : bisect_left(self.some, b)]:
            before, now, last = runs if i == last + 1 else {}, {}, i
            own = places[left[i]]
            for j in own if own[0] >= c and own[-1] < d else own[bisect_left(own, c) : bisect_left(own, d)]:
                now[j] = size = before.get(j - 1, 0) + 1 if before else 1
                if size > best:
                    best_i, best_j, best = i - size + 1, j - size + 1, size
            runs = now
        return best_i, best_j, best

    def _prepare(self) -> None:
        """Numbers of all runs of 1, 2, 4, ... usable elements, equal for equal runs; how far usable elements go on from each place."""
        both = np.concatenate(self.codes)
        good = self.usable[both]
        ends = np.flatnonzero(np.append(~good, True))
        after = ends[np.searchsorted(ends, np.arange(len(both)))]
        limit = np.where(np.arange(len(both)) < self.sizes[0], self.sizes[0], len(both))
        self.reach = np.minimum(after, limit) - np.arange(len(both))
        self.names = [both]
        size = 1
        while (self.reach >= 2 * size).any():
            at = np.flatnonzero(self.reach >= 2 * size)
            name = np.full(len(both), -1)
            _, name[at] = np.unique(self.names[-1][at] * (len(both) + 1) + self.names[-1][at + size], return_inverse=True)
            self.names.append(name)
            size *= 2

    def _by_length(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
        if self.names is None:
            self._prepare()
        shift = self.sizes[0]

        def runs(low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
            at = low + np.flatnonzero(self.reach[low : max(high - size + 1, low)] >= size)
            name = self.names[size.bit_length() - 1]
            return at, name[at] * (len(name) + 1) + name[at + size - (1 << size.bit_length() - 1)]

        low, high, best = 1, min(b - a, d - c), (a, c, 0)
        while low <= high:
            size = (low + high) // 2
            if size.bit_length() > len(self.names):
                high = size - 1
                continue
            (i, x), (j, y) = runs(a, b, size), runs(shift + c, shift + d, size)
            hit = np.flatnonzero(np.isin(x, y))
            if len(hit):
                best = int(i[hit[0]]), int(j[np.flatnonzero(y == x[hit[0]])[0]]) - shift, size
                low = size + 1
            else:
                high = size - 1
        return best


_Runs = tuple[np.ndarray, np.ndarray, np.ndarray] | list[tuple[int, int, int]]


def _within(runs: _Runs, a: int, b: int, c: int, d: int) -> _Runs:
    """What of the runs lies in left[a:b] and right[c:d]: arrays, or a list of a few."""
    if isinstance(runs, list):
        cut = [(i, j, max(a - i, c - j, 0), min(b - i, d - j, size)) for i, j, size in runs]
        return [(i + low, j + low, high - low) for i, j, low, high in cut if high > low]
    i, j, size = runs
    low = np.maximum(np.maximum(a - i, c - j), 0)
    size = np.minimum(np.minimum(b - i, d - j), size) - low
    held = (size > 0).nonzero()[0]
    i, j, size = (i + low)[held], (j + low)[held], size[held]
    return (i, j, size) if len(held) > FEW_RUNS else [*zip(i.tolist(), j.tolist(), size.tolist())]


def _longest(runs: _Runs, a: int, c: int) -> tuple[int, int, int]:
    if isinstance(runs, list):
        less, i, j = min([(-size, i, j) for i, j, size in runs], default=(0, a, c))
        return i, j, -less
    i, j, size = runs
    most = size.max()
    held = (size == most).nonzero()[0]
    i, j = i[held], j[held]
    first = i.min()
    return int(first), int(j[i == first].min()), int(most)


def matching_blocks(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """Begins and sizes of the blocks of two coded sequences, in order; neighbouring ones are joined."""
    pair = _Pair(left, right)
    x, y = pair.left, pair.right
    # Few pairs: all runs are found once, and each segment looks at those that are in it.
    runs = pair.runs() if pair.pairs[-1] <= MANY_PAIRS else None
    found, todo = [], [(0, len(x), 0, len(y), runs)]
    while todo:
        a, b, c, d, runs = todo.pop()
        if runs is None:
            i, j, size = pair.longest(a, b, c, d)
        else:
            runs = _within(runs, a, b, c, d)
            i, j, size = _longest(runs, a, c)
        while i > a and j > c and x[i - 1] == y[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < b and j + size < d and x[i + size] == y[j + size]:
            size += 1
        if size:
            found.append((i, j, size))
            if a < i and c < j:
                todo.append((a, i, c, j, runs))
            if i + size < b and j + size < d:
                todo.append((i + size, b, j + size, d, runs))
    joined: list[tuple[int, int, int]] = []
    for i, j, size in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, size = joined[-1][0], joined[-1][1], joined.pop()[2] + size
        joined.append((i, j, size))
    return joined


def ratio(left: str, right: str) -> float:
    """Twice the characters in matching blocks over all characters of both; 1 if there are none."""
    if left == right:  # all of it is one block
        return 1.0
    return 2.0 * sum(size for *_, size in matching_blocks(*coded(left, right))) / (len(left) + len(right))


def differences(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """What lies between matching blocks: replace, delete or insert, with the ranges of both sequences."""
    out, i, j = [], 0, 0
    for a, b, size in [*matching_blocks(*coded(left, right)), (len(left), len(right), 0)]:
        if i < a or j < b:
            out.append(("replace" if i < a and j < b else "delete" if i < a else "insert", i, a, j, b))
        i, j = a + size, b + size
    return out
