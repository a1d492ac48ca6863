"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and its neighbours'; the forward-backward
marginals of "good", weighted by line length, make the document's quality, which a two-parameter
curve, fitted on the same training documents, turns into a score.

Training takes at most MAX_DOCUMENTS labelled documents and MAX_LINES of their lines, whole documents
in the order of a digest of their id: that bounded sample is all that reaches the driver. Scoring
runs over whole texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import mix, slices, text_bytes

MAX_DOCUMENTS = 4000
MAX_LINES = 120_000
THRESHOLD = 0.3

OWN = 12  # features of a line itself
FEATURES = 3 * OWN + 3  # its own, those of both neighbours, whether there are any, a constant

_KINDS = np.zeros((6, 256), np.float32)
_KINDS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters; bytes of others count as such
_KINDS[1, 65:91] = 1  # capitals
_KINDS[2, 48:58] = 1  # digits
_KINDS[3, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-!?|()"]] = 1  # symbols
_KINDS[4, ord("|")] = 1
_KINDS[5, [ord("!"), ord("?")]] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and where each text's lines begin.

    Lines end at \\n; an empty text has one empty line.
    """
    data, at = text_bytes(texts)
    # Each text gets a closing line end, so that no line is lost and none spans two texts.
    ends = at[1:] + np.arange(len(at) - 1)
    joined = np.full(len(data) + len(at) - 1, 10, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[ends] = False
    joined[keep] = data
    stops = np.flatnonzero(joined == 10)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    n = len(stops)
    first = np.searchsorted(stops, np.concatenate([[-1], ends]), "right")
    out = np.zeros((n, OWN), np.float32)
    if not n:
        return out, np.zeros(0, np.float32), first
    size = (stops - begins).astype(np.float32)
    safe = np.maximum(size, 1)
    sums = np.stack([np.add.reduceat(k[joined], begins) for k in _KINDS], 1)
    out[:, 0] = np.log1p(size) / 5
    out[:, 1:7] = sums / safe[:, None]
    word = ~_SPACE[joined]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    where = np.flatnonzero(starts)
    if len(where):
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        lengths = np.flatnonzero(stop) + 1 - where
        packed = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(packed, lengths)
        hashes = np.add.reduceat(mix(joined[word].astype(np.uint64) + (within.astype(np.uint64) << np.uint64(8))), packed)
        line = np.searchsorted(stops, where)
        words = np.bincount(line, minlength=n).astype(np.float32)
        again = np.zeros(len(where), np.float32)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        symbol_end = _KINDS[3][joined[where + lengths - 1]]
        some = np.maximum(words, 1)
        out[:, 7] = np.bincount(line, weights=again, minlength=n) / some
        out[:, 8] = np.bincount(line, weights=lengths, minlength=n) / some / 10
        out[:, 9] = np.bincount(line, weights=symbol_end, minlength=n) / some
        out[:, 10] = np.log1p(words) / 4
        out[:, 11] = np.bincount(line, weights=lengths == 1, minlength=n) / some
    return out, size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's own features, those of the lines before and after in its text, and a constant."""
    n = len(own)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :OWN] = own
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    out[1:, OWN : 2 * OWN][~is_first[1:]] = own[:-1][~is_first[1:]]
    out[:-1, 2 * OWN : 3 * OWN][~is_last[:-1]] = own[1:][~is_last[:-1]]
    out[:, -3], out[:, -2], out[:, -1] = is_first, is_last, 1
    return out


def forward_backward(emit: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines x 2), expected transitions (2 x 2) and the sum of log normalisers.

    emit: log potentials of each line's labels; steps: those of neighbouring labels; first: where each
    chain begins (one more than chains; none is empty). All chains advance together, longest first.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    at, lengths = first[:-1][order], lengths[order]
    alpha, beta = emit.astype(np.float64).copy(), np.zeros_like(emit, np.float64)
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # chains longer than t
    for t in range(1, longest):
        i = at[: active[t]] + t
        alpha[i] += np.logaddexp(alpha[i - 1][:, :1] + steps[0], alpha[i - 1][:, 1:] + steps[1])
    for t in range(longest - 1, 0, -1):
        i = at[: active[t]] + t
        ahead = emit[i] + beta[i]
        beta[i - 1] = np.logaddexp(ahead[:, :1] + steps[:, 0], ahead[:, 1:] + steps[:, 1])
    norm = np.logaddexp(*(alpha[first[1:] - 1].T)) if longest else np.zeros(0)
    each = np.repeat(norm, np.diff(first))
    marginal = np.exp(alpha + beta - each[:, None])
    inner = np.ones(len(emit), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    pair = alpha[j - 1][:, :, None] + steps[None] + (emit[j] + beta[j])[:, None, :] - each[j][:, None, None]
    return marginal, np.exp(pair).sum(0), float(norm.sum())


@dataclass
class LineCrf:
    """Weights of the emissions and transitions, scales of the features, and the final curve."""

    weights: np.ndarray  # FEATURES x 2
    steps: np.ndarray  # 2 x 2
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def quality(self, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's length-weighted marginal of good lines."""
        emit = (with_neighbours(own, first) * self.scale) @ self.weights
        good = forward_backward(emit, self.steps, first)[0][:, 1]
        weight = size.astype(np.float64) + 1
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.offset, -30, 30)))


def _line_labels(x: np.ndarray, first: np.ndarray, label: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Labels of the training lines: those of a good document are good; of a bad one those that
    look bad to a logistic regression on single lines, and at least the one that looks worst."""
    each = np.repeat(label, np.diff(first)).astype(np.float64)
    weight = np.where(each == 1, 0.5 / max(each.sum(), 1), 0.5 / max((1 - each).sum(), 1)) * len(each)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-2 * len(x) ** 0.5
        g = x.T @ (weight * (p - each)) + 1e-2 * len(x) ** 0.5 * w
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-3:
            break
    good = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    out = np.where(each == 1, 1, (good > 0.6).astype(int))
    for i in np.flatnonzero(label == 0):
        own = slice(first[i], first[i + 1])
        if (out[own] * size[own]).sum() >= 0.999 * size[own].sum():
            out[first[i] + int(np.argmin(good[own]))] = 0
    return out


def train(own: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> LineCrf:
    """Fits the field on labelled texts by gradient ascent on its log likelihood (Adam)."""
    x = with_neighbours(own, first).astype(np.float64)
    scale = 1 / np.maximum(x.std(0), 1e-2)
    scale[-1] = 1
    x *= scale
    y = _line_labels(x, first, label, size)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1], y[j]), 1)
    hot = np.eye(2)[y]
    params = np.zeros(x.shape[1] * 2 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        w, s = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
        marginal, expected, _ = forward_backward(x @ w, s, first)
        g = np.concatenate([(x.T @ (hot - marginal)).ravel(), (seen - expected).ravel()]) / len(y) - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = LineCrf(params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2), scale.astype(np.float64))
    q = model.quality(own, size, first)
    a = b = 0.0
    z = np.stack([q, np.ones_like(q)], 1)
    t = np.where(label == 1, 1 - 1 / (2 + label.sum()), 1 / (2 + (1 - label).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ [a, b], -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-3
        a, b = np.array([a, b]) - np.linalg.solve(h, z.T @ (p - t) + 1e-3 * np.array([a, b]))
    model.slope, model.offset = float(max(a, 1e-6)), float(b)
    return model


def fit(documents: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_lines: int = MAX_LINES) -> LineCrf | None:
    """The field fitted on labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    labels: doc_id, quality. Rows with a null id or label are left out; of a document's repeated labels
    the lowest counts. The sample: labelled documents that are there, in the order of md5(doc_id as text); of the first
    max_documents whole ones are taken as long as they have max_lines lines together, and those that would pass that
    are passed over. Lines are counted first, so no more than the sample's features reach the driver. None if either
    label is missing.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    sizes = texts.select("doc_id", lines.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).join(known, "doc_id")
    chosen, total = [], 0
    for r in sizes.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_documents).collect():
        if total + r["n"] <= max_lines:
            chosen.append((r["doc_id"], r["quality"], len(chosen)))
            total += r["n"]
    if len({c[1] for c in chosen}) < 2:
        return None
    sample = documents.sparkSession.createDataFrame(chosen, "doc_id long, quality int, at int")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, size, first = line_features(part.column("text"))
                rows = list(zip(first[:-1], first[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("at"), part.column("quality"), pa.array([own[a:b].tobytes() for a, b in rows]), pa.array([size[a:b].tobytes() for a, b in rows])],
                    names=["at", "quality", "own", "size"],
                )

    rows = texts.join(F.broadcast(sample), "doc_id").mapInArrow(features, "at int, quality int, own binary, size binary").collect()
    rows.sort(key=lambda r: (r["at"], r["own"]))
    owns = [np.frombuffer(r["own"], np.float32).reshape(-1, OWN) for r in rows]
    sizes = [np.frombuffer(r["size"], np.float32) for r in rows]
    first = np.cumsum([0, *map(len, sizes)]).tolist()
    label = [r["quality"] for r in rows]
    label = np.array(label)
    if not len(label) or label.min() == label.max():
        return None
    return train(np.concatenate(owns), np.concatenate(sizes), np.array(first), label)


def score_documents(documents: DataFrame, model: LineCrf | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score double (0 to 1, higher: better) and predicted int added.

    Whole texts are scored; a null or empty text as one empty line, which has a score of its
    own. Without a model (no labels of both kinds) every score is 1. Repeated rows score alike; columns named
    score or predicted are replaced; an empty table gives an empty one.
    """
    kept = documents.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if model is None:
                    score = np.ones(part.num_rows)
                else:
                    score = model.score(model.quality(*line_features(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return kept.mapInArrow(run, schema)
