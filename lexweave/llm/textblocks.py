"""Words and word shingles of whole texts as 64-bit numbers, vectorised over Arrow batches.

Everything works on the UTF-8 bytes of a batch at once: word borders come from a
table of white-space bytes, each word's hash mixes its bytes, eight at a time, each
shingle's hash combines the hashes of its words. Two different words or shingles
share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 2_000_000
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (one more than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most that many bytes of text, or of one row."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z lower-cased, and where each text's words begin (one more than texts)."""
    data, at = text_bytes(texts)
    hashes, begins = _words(data, at)
    return hashes, np.searchsorted(begins, at) if len(begins) else np.zeros(len(at), np.int64)


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word, the number of the line it is in, counted over all texts, and each text's first line
    (one more than texts). Lines end at \\n; every text has one at least."""
    data, at = text_bytes(texts)
    hashes, begins = _words(data, at)
    ends = np.flatnonzero(data == 10)
    line = np.searchsorted(ends, begins, "right") + np.searchsorted(at, begins, "right") - 1
    return hashes, line, np.searchsorted(ends, at) + np.arange(len(at))


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and the bytes at which they begin; texts begin at `at`."""
    return separated(data, at, _SPACE)[:2]


def separated(data: np.ndarray, at: np.ndarray, apart: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what stands between the bytes marked in `apart` (256 flags), A-Z lower-cased, and the bytes at which each begins and ends.

    Texts begin at `at`. Each seed gives other hashes.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return none
    word = ~apart[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begins):
        return none
    lengths = ends - begins
    # Eight bytes of every word at a time, read as one number wherever they begin.
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=padded[:-8])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    hashes = mix((lengths.astype(np.uint64) * (_PLACE[0] ^ np.uint64(seed << 1))) ^ (eight[begins] & _MASK[np.minimum(lengths, 8)]))
    done, more = 8, np.flatnonzero(lengths > 8)
    while len(more):
        left = lengths[more] - done
        hashes[more] = mix(hashes[more] ^ (eight[begins[more] + done] & _MASK[np.minimum(left, 8)]))
        done, more = done + 8, more[left > 8]
    return hashes, begins, ends


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of five words, repeats included, and where each text's runs begin.

    A text of one to four words has one: the whole sequence. One without words has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    n = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_at[-1], np.uint64)
    if len(words) >= SHINGLE_WORDS:
        runs = sum((words[k : len(words) - SHINGLE_WORDS + 1 + k] * _PLACE[k] for k in range(SHINGLE_WORDS)), np.uint64(0))
        long = counts >= SHINGLE_WORDS
        take = np.repeat(at[:-1][long] - out_at[:-1][long], n[long]) + np.flatnonzero(np.repeat(long, n))
        out[np.repeat(long, n)] = runs[take]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        own = words[at[i] : at[i + 1]]
        out[out_at[i]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_at


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles, ascending."""
    hashes, at = shingle_hashes(texts)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
