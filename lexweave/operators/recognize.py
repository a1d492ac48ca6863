"""A recogniser of people, organisations and places: a sequence tagger over word features, decoded by Viterbi's algorithm.

Every word has features (itself, its neighbours, endings, shapes, signs beside it), hashed into a table of weights; labels of
neighbouring words weigh as well. It is fitted by the averaged structured perceptron on a bounded sample of labelled
texts, which must fit the driver: at most MOST_TEXTS of them, in the order of a hash of the text. All sentences of a batch
are decoded side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lexweave.functions.phrases import Words

#: What a recogniser gives; has_fact: it knows more of a person than the words.
FOUND = "array<struct<start:int,end:int,entity_type:string,confidence:double,has_fact:boolean>>"
TYPES = ("PER", "ORG", "АДРЕС")
#: Texts of the sample, and rows of the table of weights.
MOST_TEXTS = 2_000
ROWS = 1 << 17
EPOCHS = 6
_FEATURES = 11
_MIX = np.uint64(0x9E3779B97F4A7C15)
_QUOTES = {ord(a): ord(b) for a, b in zip("«\"„“'", "»\"“”'")}


class _Sentences:
    """The words of texts with their features and the sentences they make."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        words = self.words = Words(texts)
        n = len(words.begin)
        points = np.append(words.points, np.uint32(32))
        whole, lower = words.hashes(False), words.hashes(True)

        def ending(k: int) -> np.ndarray:
            short = copy(words)
            short.begin = np.maximum(words.begin, words.end - k)
            return short.hashes(True)

        first, last, size = points[words.begin], points[words.end - 1], words.end - words.begin
        dotted = np.zeros(n, bool)
        if n:
            dots = np.concatenate([[0], np.cumsum(points == 46)])
            dotted = dots[words.end] > dots[words.begin]
        upper = words.upper()
        plain = whole == lower
        # Capitals throughout, one capital, a capital first, a figure first, or neither.
        shape = np.where(upper & ((size == 1) | dotted), 1, np.where(upper & (size > 1) & _all_capitals(words), 2, np.where(upper, 3, np.where((first >= 48) & (first < 58), 4, np.where(plain, 5, 6))))).astype(np.uint64)
        before = points[np.maximum(words.begin - 1, 0)].astype(np.uint64) * (words.start > 0)
        after = points[words.end].astype(np.uint64)
        # A sentence ends at a line's end, or where a stop stands before a capital and no initial does.
        gap_ends = np.concatenate([[0], np.cumsum(np.isin(points, [10, 13]))])
        stops = np.isin(points[words.end], [33, 46, 63]) & ~((shape == 1) & (size <= 5))
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = (words.row[1:] != words.row[:-1]) | (gap_ends[words.begin[1:]] > gap_ends[words.end[:-1]]) | (stops[:-1] & upper[1:])
        self.sentence = np.cumsum(new) - 1
        self.place = np.arange(n) - np.flatnonzero(new)[self.sentence] if n else np.zeros(0, np.int64)

        def beside(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, x.dtype)
            if k > 0:
                out[:-k] = np.where(self.sentence[k:] == self.sentence[:-k], x[k:], 0)
            else:
                out[-k:] = np.where(self.sentence[-k:] == self.sentence[:k], x[:k], 0)
            return out

        one, five = np.uint64(1), np.uint64(8)
        around = beside(shape, -1) * five * five + shape * five + beside(shape, 1)
        columns = (
            lower, ending(3) + shape, ending(2) * five + shape, beside(lower, -1), beside(lower, 1), around, before * five + shape, after * five + shape,
            beside(lower, -2) + beside(lower, -1) * _MIX, beside(shape, -2) * five * five * five + around, shape + one,
        )
        self.features = np.stack([((c + np.uint64(k + 1)) * _MIX * (np.uint64(2 * k) + one) >> np.uint64(47)).astype(np.int64) % ROWS for k, c in enumerate(columns)], axis=1) if n else np.zeros((0, _FEATURES), np.int64)


def _all_capitals(words: Words) -> np.ndarray:
    low = np.concatenate([[0], np.cumsum(_small(words.points))])
    return low[words.end] == low[words.begin]


def _small(points: np.ndarray) -> np.ndarray:
    from lexweave.functions.phrases import _letters

    return _letters.word[points] & ~_letters.upper[points]


class Tagger:
    """Weights of features by label, of labels by the label before (the last row: a sentence's first word)."""

    def __init__(self, types: Sequence[str]) -> None:
        self.types = tuple(types)
        self.labels = ["O", *(f"{p}-{t}" for t in self.types for p in "BI")]
        self.weights = np.zeros((ROWS, len(self.labels)), np.float32)
        self.moves = np.zeros((len(self.labels) + 1, len(self.labels)), np.float32)
        # I-X stands after B-X or I-X only.
        self.barred = np.zeros_like(self.moves, bool)
        for k in range(len(self.types)):
            inside = 2 + 2 * k
            self.barred[:, inside] = True
            self.barred[[inside - 1, inside], inside] = False

    def decode(self, scores: np.ndarray, sentence: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The best labels of all sentences, each position of all of them at once."""
        out = np.zeros(len(scores), np.int64)
        if not len(scores):
            return out
        moves = np.where(self.barred, np.float32(-1e9), self.moves)
        longest = int(place.max()) + 1
        first = np.flatnonzero(place == 0)
        sizes = np.diff(np.append(first, len(scores)))
        came = np.zeros((len(scores), len(self.labels)), np.int8)
        best = np.full((len(first), len(self.labels)), np.float32(-1e9))
        for at in range(longest):
            alive = np.flatnonzero(sizes > at)
            rows = first[alive] + at
            if at == 0:
                best[alive] = moves[-1] + scores[rows]
            else:
                through = best[alive][:, :, None] + moves[None, :-1, :]
                came[rows] = through.argmax(axis=1)
                best[alive] = through.max(axis=1) + scores[rows]
        label = best.argmax(axis=1)
        for at in range(longest - 1, -1, -1):
            alive = np.flatnonzero(sizes > at)
            rows = first[alive] + at
            out[rows] = label[alive]
            label[alive] = came[rows, label[alive]]
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(self.labels)), np.float32)
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def spans(self, texts: Sequence[str | None]) -> list[list[dict]]:
        """What is recognised in each text, by start."""
        cut = _Sentences(texts)
        words, out = cut.words, [[] for _ in texts]
        scores = self.scores(cut.features)
        labels = self.decode(scores, cut.sentence, cut.place)
        if not len(labels):
            return out
        order = np.sort(scores, axis=1)
        sure = 1 / (1 + np.exp(-(order[:, -1] - order[:, -2]).astype(np.float64)))
        at = np.flatnonzero(labels % 2 == 1)
        for i in at.tolist():
            j = i
            while j + 1 < len(labels) and labels[j + 1] == labels[i] + 1 and cut.sentence[j + 1] == cut.sentence[i]:
                j += 1
            text = texts[words.row[i]]
            start, end = int(words.start[i]), int(words.stop[j])
            # An initial takes its full stop along, a name in quotation marks its last one.
            if text[end : end + 1] == "." and (end - words.start[j] == 1 or "." in text[words.start[j] : end]) and text[words.start[j]].isupper():
                end += 1
            inside = text[start:end]
            close = next((chr(_QUOTES[ord(c)]) for c in reversed(inside) if ord(c) in _QUOTES and chr(_QUOTES[ord(c)]) not in inside[inside.rindex(c) + 1 :]), None)
            if close and text[end : end + 1] == close:
                end += 1
            out[words.row[i]].append({"start": start, "end": end, "entity_type": self.types[(labels[i] - 1) // 2], "confidence": round(float(sure[i : j + 1].mean()), 4), "has_fact": False})
        return out


def _gold(cut: _Sentences, spans: list[list[tuple[int, int, str]]], types: Sequence[str]) -> np.ndarray:
    """The label of each word: of the span that it lies in, else none."""
    labels = np.zeros(len(cut.words.begin), np.int64)
    for row, own in enumerate(spans):
        a, b = np.searchsorted(cut.words.row, [row, row + 1])
        for start, end, kind in own:
            inside = a + np.flatnonzero((cut.words.start[a:b] >= start) & (cut.words.stop[a:b] <= end))
            if len(inside) and kind in types:
                labels[inside] = 2 + 2 * types.index(kind)
                labels[inside[0]] = 1 + 2 * types.index(kind)
    return labels


def fit(sample: DataFrame, types: Sequence[str] = TYPES, most_texts: int = MOST_TEXTS, epochs: int = EPOCHS, seed: int = 7) -> Tagger:
    """The tagger of labelled texts (text, spans: array of start, end, entity_type). Null texts and spans are left out."""
    rows = sample.where("text is not null and spans is not null").select("text", F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["entity_type"])).alias("spans"))
    rows = rows.orderBy(F.xxhash64("text"), "text").limit(most_texts).collect()
    tagger = Tagger(types)
    cut = _Sentences([r["text"] for r in rows])
    gold = _gold(cut, [[tuple(s) for s in r["spans"]] for r in rows], tagger.types)
    borders = np.append(np.flatnonzero(cut.place == 0), len(gold))
    total, total_moves = np.zeros(tagger.weights.shape, np.float64), np.zeros(tagger.moves.shape, np.float64)
    rng, step = np.random.default_rng(seed), 1
    for _ in range(epochs):
        for s in rng.permutation(len(borders) - 1):
            a, b = borders[s], borders[s + 1]
            features, want = cut.features[a:b], gold[a:b]
            got = tagger.decode(tagger.scores(features), np.zeros(b - a, np.int64), np.arange(b - a))
            wrong = np.flatnonzero(got != want)
            for label, by in ((want, 1.0), (got, -1.0)):
                flat = features[wrong].reshape(-1), np.repeat(label[wrong], features.shape[1])
                np.add.at(tagger.weights, flat, by)
                np.add.at(total, flat, by * step)
                if len(wrong):
                    move = np.append(-1, label[:-1]), label
                    np.add.at(tagger.moves, move, by)
                    np.add.at(total_moves, move, by * step)
            step += 1
    # The mean of the weights after all steps.
    tagger.weights -= (total / step).astype(np.float32)
    tagger.moves -= (total_moves / step).astype(np.float32)
    return tagger


def recognize(documents: DataFrame, tagger: Tagger, name: str = "ner") -> DataFrame:
    """documents (text, ...) with a column of candidates, which `anonymize(ner=name)` takes; a null or empty text has none."""
    held = documents.sparkSession.sparkContext.broadcast(tagger)
    kind = to_arrow_type(_parse_datatype_string(FOUND))

    def find(text: pa.Array) -> pa.Array:
        return pa.array(held.value.spans(text.to_pylist()), kind)

    return documents.withColumn(name, F.arrow_udf(find, FOUND)(F.col("text")))
