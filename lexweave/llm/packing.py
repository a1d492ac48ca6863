"""Packing documents into token sequences, balanced by attention cost.

A sequence's cost is a linear plus a quadratic term for each piece in it, as attention
stays within a piece. Longest first, each document goes to the sequence of the lowest
cost that has room; it is cut where no sequence has room for all of it. Whole
sequences come off long documents first.

Packing needs no order over the corpus, so every task packs the documents of its own
partition, some hundred thousand tokens at a time: no shuffle, bounded memory, and a lost task
is simply run again. Each such portion leaves less than one sequence of padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import slices

SEQUENCE = 1024
#: Tokens packed together; more bring less padding and take more memory.
PORTION = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(tokens: int, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE) -> float:
    """What a piece of so many tokens costs."""
    return linear * tokens + quadratic * tokens * tokens


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids as the `tokenizers` library gives them with add_special_tokens=False.

    A plain byte-level BPE whose ids are in the order of its merges is run by tiktoken over the
    same vocabulary, which gives the same ids several times faster; any other by tokenizers itself.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    slow = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return slow
    try:
        import public_tokenizers
        import tiktoken
    except ImportError:
        return slow
    # The printable stand-ins that byte-level vocabularies have for bytes.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    if ids != sorted(ids) or len(ranks) != 256 + len(merges):
        return slow
    fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def quick(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        except ValueError:  # its search gives up on some texts, as on a million blanks in a row
            return slow(text)

    probe = "Sphinx of  black quartz,\n\njudge my vow's 12345 ñandú — مرحبا 漢字 " + "".join(special)
    return quick if np.array_equal(quick(probe), slow(probe)) else slow


def assign(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    Of the sequences that have room for all of a piece it goes to the one of the lowest cost, of equal ones to the first. Where
    none has, the one of the lowest cost that has any room takes what it can, and the rest is a piece of its own. The
    sequences' number is the least possible.
    """
    out, tails = [], []
    sequences = 0
    for i, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((i, start, size, sequences, 0))
            sequences += 1
        if n % size:
            tails.append((n % size, i, n - n % size))
    tails.sort(key=lambda t: (-t[0], t[1]))
    open_ = -(-sum(t[0] for t in tails) // size)
    spent, used = np.zeros(open_), np.zeros(open_, np.int64)
    work = [*reversed(tails)]
    while work:
        n, i, start = work.pop()
        fits = used <= size - n
        k = int(np.argmin(np.where(fits if fits.any() else used < size, spent, np.inf)))
        part = min(n, size - int(used[k]))
        out.append((i, start, part, sequences + k, int(used[k])))
        spent[k] += cost(part)
        used[k] += part
        if part < n:
            work.append((n - part, i, start + part))
    return out


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = SEQUENCE, portion: int = PORTION) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `documents` has doc_id and text; other columns are left out. A document is its ids, then id 0; a null
    or empty text is id 0 alone. Repeated rows are documents of their own, each packed. A text
    of any length is tokenised whole and cut where sequences end. sequence_id holds the
    task's partition and a running number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer_path)
        zero = np.zeros(1, np.uint32)
        next_sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            rows = assign([len(ids) for _, ids in held], size)
            crcs = [zlib.crc32(held[i][1][start : start + n].astype("<u4").tobytes()) for i, start, n, _, _ in rows]
            cols = [
                pa.array([held[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array(crcs, pa.int64()),
                pa.array([len(held[r[0]][1]) for r in rows], pa.int64()),
                pa.array([next_sequence + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            next_sequence += 1 + max(r[3] for r in rows)
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.concatenate([encode(text or ""), zero])
                    held.append((doc_id, ids))
                    tokens += len(ids)
                    if tokens >= portion:
                        yield flush()
                        held, tokens = [], 0
        if held:
            yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)
