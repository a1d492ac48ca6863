"""Code pages told by pairs of bytes: counted over texts in one aggregation, then scored for any file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Eight-bit pages of Cyrillic and Western texts; of equal scores the earlier one counts.
PAGES = ("cp1251", "cp866", "koi8-r", "mac_cyrillic", "cp1252", "cp850", "mac_roman")
_PAIRS = 1 << 16
_SLICE = 1 << 20


def _pairs(raw: bytes) -> np.ndarray:
    """Numbers of neighbouring bytes of which one at least isn't ASCII; ASCII pairs are alike in all pages."""
    data = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.int64)
    pair = data[:-1] * 256 + data[1:]
    return pair[(pair & 0x8080) > 0]


class Charsets:
    """For each page the logarithm of every pair's share."""

    def __init__(self, pages: Sequence[str], counts: np.ndarray) -> None:
        self.pages = tuple(pages)
        # One scale for all: a page that was taught little must not score well by knowing nothing.
        smoothed = counts + 0.5
        self.scores = np.log(smoothed / smoothed.sum(axis=1).max()).astype(np.float32)

    def of(self, raw: bytes) -> str:
        """The page of a file: utf-8 where it is that, else the likeliest page that can read all of it, else latin-1."""
        try:
            raw.decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            pass
        score = np.zeros(len(self.pages))
        for at in range(0, len(raw), _SLICE):
            score += self.scores[:, _pairs(raw[at : at + _SLICE])].sum(axis=1, dtype=np.float64)
        for k in np.argsort(-score, kind="stable"):
            try:
                raw.decode(self.pages[k])
                return self.pages[k]
            except UnicodeDecodeError:
                continue
        return "latin-1"


def learn(texts: DataFrame, pages: Sequence[str] = PAGES, column: str = "text") -> Charsets:
    """The pairs of all texts, as each page would write them; characters that a page lacks are passed over. Null texts teach nothing.

    What comes to the driver is one row a page, 512 kB each.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pages), _PAIRS), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k, page in enumerate(pages):
                    total[k] += np.bincount(_pairs(text.encode(page, "ignore")), minlength=_PAIRS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["page", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"page": group.column("page").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    # Added up in two rounds, so that no task has to hold what all others counted.
    parts = texts.select(F.col(column).cast("string").alias("text")).where("text is not null").mapInArrow(count, "page int, counts binary")
    dealt = parts.withColumn("part", F.floor(F.rand(1) * 64).cast("int")).groupBy("page", "part").applyInArrow(lambda key, group: add(group.drop(["part"])), "page int, counts binary")
    rows = dealt.groupBy("page").applyInArrow(add, "page int, counts binary").collect()
    counts = np.zeros((len(pages), _PAIRS), np.int64)
    for r in rows:
        counts[r["page"]] = np.frombuffer(r["counts"], np.int64)
    return Charsets(pages, counts)


def with_charset(files: DataFrame, model: Charsets, content: str = "content", page: str = "charset", text: str = "text") -> DataFrame:
    """files with two more columns: the page of their bytes and the text read with it; null bytes have neither."""
    held = files.sparkSession.sparkContext.broadcast(model)

    def find(raw: pa.Array) -> pa.Array:
        out = []
        for x in raw.to_pylist():
            name = None if x is None else held.value.of(x)
            out.append(None if x is None else {"page": name, "text": x.decode(name)})
        return pa.array(out, pa.struct([("page", pa.string()), ("text", pa.string())]))

    both = "_lexweave_charset"
    found = files.withColumn(both, F.arrow_udf(find, "page string, text string")(F.col(content)))
    return found.withColumns({page: F.col(both)["page"], text: F.col(both)["text"]}).drop(both)
