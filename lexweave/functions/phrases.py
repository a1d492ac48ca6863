"""Words of whole batches of texts, and a dictionary of phrases as a trie in flat arrays that all words walk at once.

A word reaches from the first to the last letter, digit or underscore of a piece without white space. Words are hashed
from their code points; words of equal hash are compared letter by letter, so hashes decide nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 3
_LETTERS = 0x110000
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Letters:
    """What each code point is; filled in as they come."""

    def __init__(self) -> None:
        self.known = np.zeros(_LETTERS, bool)
        self.space, self.word, self.upper = (np.zeros(_LETTERS, bool) for _ in range(3))
        self.lower = np.arange(_LETTERS, dtype=np.uint32)

    def learn(self, points: np.ndarray) -> None:
        new = np.zeros(_LETTERS, bool)
        new[points] = True
        for p in np.flatnonzero(new & ~self.known).tolist():
            c = chr(p)
            self.space[p], self.word[p], self.upper[p] = c.isspace(), c.isalnum() or c == "_", c.isupper()
            self.lower[p] = ord(c.lower()) if len(c.lower()) == 1 else p
        self.known |= new


_letters = _Letters()


def lowered(text: str) -> str:
    """The text in lower case, letter by letter, so that its length stays."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Words:
    """The words of many texts: the row each is in, where in its text it begins and ends, and its hash."""

    def __init__(self, texts: Sequence[str | None], seed: int = 0) -> None:
        sizes = np.array([len(t or "") for t in texts], np.int64)
        # A blank after each text ends its last word.
        points = np.frombuffer("".join(f"{t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        _letters.learn(points)
        self.points, self.seed = points, seed
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        space, word = _letters.space[points], np.flatnonzero(_letters.word[points])
        piece = np.cumsum(space)[word]
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.begin = word[first]
        self.end = word[np.append(first[1:], len(word)) - 1] + 1 if len(word) else self.begin
        self.row = np.searchsorted(self.at, self.begin, "right") - 1
        self.start, self.stop = self.begin - self.at[self.row], self.end - self.at[self.row]

    def letters(self, which: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some words all code points one after another, where each word begins among them, and the places in their words."""
        sizes = self.end[which] - self.begin[which]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(which) else sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        found = self.points[np.repeat(self.begin[which], sizes) + place]
        return _letters.lower[found] if lower else found, first, place

    def hashes(self, lower: bool) -> np.ndarray:
        """Of each word, in lower case if asked."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        points, first, place = self.letters(np.arange(len(self.begin)), lower)
        x = (points.astype(np.uint64) + np.uint64(self.seed + 1)) * _STEP ^ (place.astype(np.uint64) + np.uint64(1)) * _SPREAD
        x = (x ^ (x >> np.uint64(29))) * _SPREAD
        x = x ^ (x >> np.uint64(32))
        return np.add.reduceat(x * _STEP, first)

    def upper(self) -> np.ndarray:
        """Whether each word begins with a capital."""
        return _letters.upper[self.points[self.begin]]


class Phrases:
    """Phrases of up to three words as a trie: sorted word hashes, and sorted (node, word) keys with the nodes they lead to."""

    def __init__(self, phrases: Sequence[str] | pa.Array, lower: bool = True) -> None:
        said = pc.unique(pa.array(phrases, pa.large_string()) if not isinstance(phrases, pa.Array) else phrases.cast(pa.large_string()))
        parts = pc.split_pattern(said, " ")
        sizes, flat = np.asarray(pc.list_value_length(parts)).astype(np.int64), pc.list_flatten(parts)
        row = np.repeat(np.arange(len(said)), sizes)
        fit = sizes <= LONGEST
        fit[row[np.asarray(pc.equal(flat, "")).astype(bool)]] = False
        self.lower, self.phrases = lower, said.filter(pa.array(fit))
        coded = flat.filter(pa.array(fit[row])).dictionary_encode()
        different, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        sizes = sizes[fit]
        row = np.repeat(np.arange(len(sizes)), sizes)
        for self.seed in range(100):
            held = Words(different, self.seed)
            # A phrase's words that aren't words of a text, as those with a mark at an end, can't be met.
            whole = np.zeros(len(different), bool)
            lengths = np.array([len(w) for w in different], np.int64)
            full = (held.start == 0) & (held.stop == lengths[held.row]) if len(held.row) else np.zeros(0, bool)
            whole[held.row[full]] = True
            hashes = np.zeros(len(different), np.uint64)
            hashes[held.row[full]] = held.hashes(False)[full]
            self.words = np.unique(hashes[whole])
            if len(self.words) == whole.sum():
                break
        # The words' own code points, in the order of their hashes.
        order = np.flatnonzero(whole)[np.argsort(hashes[whole])]
        self.size = np.array([len(different[i]) for i in order], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1] if len(order) else self.size
        self.points = np.frombuffer("".join(different[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.where(whole, np.searchsorted(self.words, hashes), -2) if len(different) else np.zeros(0, np.int64)
        rows = np.full((len(sizes), LONGEST), -1, np.int64)
        rows[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = number[code]
        index = np.flatnonzero((rows != -2).all(axis=1))
        rows = rows[index]
        # Nodes of depth 1 are words; deeper ones are numbered by their sorted keys.
        node, self.keys, self.ends = rows[:, 0], [], []
        for depth in range(LONGEST):
            if depth:
                going = rows[:, depth] >= 0
                keys = np.unique(node[going] * len(self.words) + rows[going, depth])
                node = np.where(going, np.searchsorted(keys, node * len(self.words) + rows[:, depth]), -1)
                self.keys.append(keys)
            ends = np.full(len(self.keys[-1]) if depth else len(self.words), -1, np.int64)
            last = (node >= 0) & ((rows[:, depth + 1] < 0) if depth + 1 < LONGEST else True)
            ends[node[last]] = index[last]
            self.ends.append(ends)

    def found(self, words: Words) -> np.ndarray:
        """For each word and each size, one to three, the number of the phrase that begins there, or -1: an array of rows."""
        out = np.full((len(words.begin), LONGEST), -1, np.int64)
        if not len(self.words) or not len(words.begin):
            return out
        hashes = words.hashes(self.lower)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        word = np.where(self.words[at] == hashes, at, -1)
        # Words of equal hash have to be equal.
        word[(word >= 0) & (words.end - words.begin != self.size[at])] = -1
        some = np.flatnonzero(word >= 0)
        if len(some):
            points, first, place = words.letters(some, self.lower)
            own = np.repeat(self.first[word[some]], self.size[word[some]]) + place
            word[some[~np.logical_and.reduceat(points == self.points[own], first)]] = -1
        node = word
        out[:, 0] = np.where(node >= 0, self.ends[0][node], -1)
        for depth in range(1, LONGEST):
            if not len(self.keys[depth - 1]):
                break
            next_word = np.append(word[depth:], np.full(min(depth, len(word)), -1))
            same = np.append(words.row[depth:] == words.row[: len(word) - depth], np.zeros(min(depth, len(word)), bool))
            going = np.flatnonzero((node >= 0) & (next_word >= 0) & same)
            key = node[going] * len(self.words) + next_word[going]
            at = np.minimum(np.searchsorted(self.keys[depth - 1], key), len(self.keys[depth - 1]) - 1)
            node = np.full(len(word), -1)
            node[going] = np.where(self.keys[depth - 1][at] == key, at, -1)
            out[:, depth] = np.where(node >= 0, self.ends[depth][node], -1)
        return out

    def __getstate__(self) -> dict:
        """Tasks have no use for the phrases as texts."""
        return self.__dict__ | {"phrases": None}

    def phrase(self, number: int) -> str:
        return self.phrases[number].as_py()

    def __len__(self) -> int:
        return len(self.phrases)
