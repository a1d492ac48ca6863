"""Counting hashed items over all documents in a table of fixed size, which orders items by rarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import slices

#: Hashed counters, 4 bytes each: 4 MB for every task.
COUNTERS = 1 << 20
_CHUNK = 4096


def count_items(texts: DataFrame, items: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """How many items each counter has, over all rows of texts (text); items() gives the hashes of an array of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(items(part.column("text")) & np.uint64(COUNTERS - 1), minlength=COUNTERS).astype(np.uint32)
        for chunk in range(COUNTERS // _CHUNK):
            own = total[chunk * _CHUNK : (chunk + 1) * _CHUNK]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([own[at].tobytes()])], names=["chunk", "at", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, np.int64)
        for at, n in zip(pdf["at"], pdf["n"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "n": [total.tobytes()]})

    parts = texts.select("text").mapInArrow(run, "chunk int, at binary, n binary")
    out = np.zeros(COUNTERS, np.int64)
    for r in parts.groupBy("chunk").applyInPandas(add, "chunk int, n binary").collect():  # 8 MB, whatever the input
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["n"], np.int64)
    return out


def rarity(counters: np.ndarray) -> np.ndarray:
    """A byte for each counter that grows with its count."""
    return np.minimum(np.log2(counters + 1) * 4, 127).astype(np.uint8)


def rarity_keys(hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Numbers whose order is the order of rarity: the counter's byte, then 56 bits of the hash."""
    return (rare[hashes & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
