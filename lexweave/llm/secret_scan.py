"""Secret scans: all rules in one pass over the bytes of whole texts, by a combined deterministic automaton.

The automaton (see automaton.py) is compiled once on the driver and finds where matches end. Only there, which is rare,
a rule's own expression is run backwards to find where the match began, and its head forwards to measure the tail.
Texts stay in their partitions: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import END, Anchored, Rule, compiled
from .textblocks import slices, text_bytes


def _either(word: str) -> str:
    """The word with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
#: These come first in every digest.
BASE = (
    Rule("assign", f"({_KEY})[\"']? *[:=] *[\"']?", "[A-Za-z0-9+/_.=-]+", 8),
    Rule("access", "AKIA", "[A-Z0-9]+", 12),
    Rule("hex", "", "[0-9a-f]{32,}", 32),
)
#: Keys that services mark by a prefix, and signed web tokens.
RULES = (
    *BASE,
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]+", 10),
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(rules: tuple[Rule, ...], tools: list[tuple[Anchored, Anchored]], data: np.ndarray, at: np.ndarray, ends: np.ndarray, whose: np.ndarray) -> dict[int, list]:
    """The spans of each text that has some, in code points. Text i is data[at[i] + i : at[i + 1] + i]."""
    starts = at[:-1] + np.arange(len(at) - 1)
    of = np.searchsorted(starts, ends, "right") - 1
    out: dict[int, list] = {}
    raw, last = data.tobytes(), [0] * len(rules)
    for end, bits, text in zip(ends.tolist(), whose.tolist(), of.tolist()):
        for k, rule in enumerate(rules):
            if not bits >> k & 1:
                continue
            back, head = tools[k]
            start = back.longest(raw, end, max(last[k], int(starts[text])))
            last[k] = end
            if end - head.longest(raw, start, end) >= rule.least:
                out.setdefault(text, []).append((start, k, end))
    for text, found in out.items():
        begin = int(starts[text])
        # Code points up to a place: bytes that don't continue one.
        points = np.concatenate([[0], np.cumsum((data[begin : int(at[text + 1]) + text] & 0xC0) != 0x80)])
        out[text] = [{"kind": rules[k].kind, "start": int(points[a - begin]), "end": int(points[b - begin])} for a, k, b in sorted(found)]
    return out


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a row of documents: doc_id, spans: array<struct<kind, start, end>> in code points, end exclusive.

    `documents` has doc_id and text; other columns are left out. A rule's matches are leftmost, greedy and don't overlap;
    those with a tail shorter than its least are dropped after that. Spans of different rules may overlap; they stand by
    start, then in the rules' order. Null texts count as empty, which have none; null and repeated ids are rows like
    others; texts of any length are scanned whole; an empty table gives an empty one. Rules whose match may run on after
    its end without ending well again raise an error.
    """
    automaton = compiled(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [(Anchored(r.head + r.tail, backwards=True), Anchored(r.head)) for r in rules]
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts, at = text_bytes(part.column("text"))
                data = np.insert(texts, at[1:], END)
                ends, whose = automaton.ends(data)
                found = _spans(rules, tools, data, at, ends, whose)
                spans = pa.array([found.get(i, []) for i in range(part.num_rows)], _SPANS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], names=["doc_id", "spans"])

    kind = documents.select("doc_id").schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def scan_digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base rules' spans, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
