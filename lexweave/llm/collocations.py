"""Phrase collocations: frequent phrases by pivot partitioning, scored by their weakest cut.

Words rarer than the least frequency break pieces into fragments, as no frequent phrase has them. Each occurrence of a
phrase belongs to one word in it, its pivot: the rarest, and of several equal ones the first. For each place the words
around it that aren't rarer, four on either side at most, are written as ids and sent to the bucket of that word,
equal ones once with their count. A bucket mines its pivots' phrases by itself: they grow word by word from the pivot,
and what isn't frequent doesn't grow further.

The order of rarity is read from a table of bytes of a fixed most size, so it is rough where very many words are
frequent; any order gives the same phrases, a rough one only spreads them less evenly. A pivot that is itself too
frequent for one bucket is dealt out over several, whose counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .textblocks import _PLACE, mix, separated, slices, text_bytes

LONGEST = 5
#: Words of text for each bucket, and the occurrences of a pivot from which it is dealt out over several.
BUCKET_WORDS = 1 << 20
PIVOT_MOST = 1 << 20
#: The table that tells frequent words has so many bytes for each, and no more than the last in all.
BYTES_A_WORD, LEAST_BYTES, MOST_BYTES = 32, 1 << 16, 1 << 24
_SLICE = 4_000_000
_FLUSH = 400_000

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_APART = _ENDS_PIECE.copy()
_APART[[0x20, 0x09]] = True
_REACH = LONGEST - 1
_SPREAD = mix(np.arange(1, 2 * LONGEST + 1, dtype=np.uint64) * _PLACE[1]) | np.uint64(1)


class _Words:
    """The words of a slice of texts: ids of language and word, the piece each is in, its bytes, and the row of each."""

    def __init__(self, part: pa.RecordBatch, seed: int) -> None:
        self.data, at = text_bytes(part.column("text"))
        self.langs = part.column("lang").fill_null("und").dictionary_encode()
        hashes, self.begins, self.ends = separated(self.data, at, _APART, seed)
        row = np.searchsorted(at, self.begins, "right") - 1
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False)[row]
        names = [blake2b(x.encode(), digest_size=8).digest() for x in self.langs.dictionary.to_pylist()]
        self.ids = mix(hashes + np.frombuffer(b"".join(names), np.uint64)[self.lang])
        self.piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[self.data]), self.begins) + row

    def counted(self) -> pa.Table:
        """Each different word with its language, id and count."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.begins] += 1
        inside[self.ends] -= 1
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        letters = lower[self.data[np.cumsum(inside[:-1]).astype(bool)]]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.begins)])
        words = pa.LargeStringArray.from_buffers(len(self.begins), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        both = self.lang.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
        _, first, n = np.unique(both, return_index=True, return_counts=True)
        first = pa.array(first)
        return pa.table({
            "id": pa.array(self.ids.view(np.int64)).take(first), "lang": self.langs.dictionary.cast(pa.string()).take(pa.array(self.lang).take(first)),
            "word": words.dictionary.cast(pa.string()).take(words.indices.take(first)), "n": pa.array(n.astype(np.int64)),
        })


def _count_words(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n over all texts; tasks add up what they have read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            together = pa.concat_tables(held).group_by(["id", "lang", "word"]).aggregate([("n", "sum")])
            return together.rename_columns(["id", "lang", "word", "n"]).select(["id", "lang", "word", "n"])

        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                held.append(_Words(part, seed).counted())
                if sum(t.num_rows for t in held) > _FLUSH:
                    held = [added()]
                    if held[0].num_rows > _FLUSH // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    parts = texts.mapInArrow(run, "id bigint, lang string, word string, n bigint")
    return parts.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _levels(frequent: DataFrame, slots: int) -> np.ndarray:
    """A byte for each slot of ids: 0 if no frequent word has it, else what grows with the most frequent one's count."""
    level = (F.floor(F.log2("n") * 4) + 1).cast("smallint")
    found = frequent.groupBy(F.col("id").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(F.max(level).alias("level")).toArrow()  # at most MOST_BYTES rows
    out = np.zeros(slots, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out


def _fragments(words: _Words, levels: np.ndarray, buckets: int, pivot_most: int) -> Iterator[tuple[int, bytes]]:
    """Bucket and packed fragments of a slice: their shapes, counts and ids, equal ones together."""
    ids = words.ids
    level = levels[ids & np.uint64(len(levels) - 1)]
    order = (level.astype(np.uint64) << np.uint64(56)) | (ids >> np.uint64(8))
    size = len(ids)
    left, right = np.zeros(size, np.int8), np.zeros(size, np.int8)
    if not size:
        return
    for k in range(1, min(_REACH, size - 1) + 1):
        near = (words.piece[k:] == words.piece[:-k]) & (level[k:] > 0) & (level[:-k] > 0)
        left[k:][near & (left[k:] == k - 1) & (order[:-k] > order[k:])] = k
        right[:-k][near & (right[:-k] == k - 1) & (order[k:] >= order[:-k])] = k
    at = np.flatnonzero(left + right)
    if not len(at):
        return
    left, right = left[at], right[at]
    row = np.zeros((len(at), 2 * _REACH + 2), np.uint64)
    for k in range(-_REACH, _REACH + 1):
        held = np.flatnonzero((k >= -left) & (k <= right))
        row[held, k + _REACH] = ids[at[held] + k]
    copies = np.ceil(np.exp2(level[at] / 4.0) / pivot_most).astype(np.int64)
    row[:, -1] = (left * LONGEST + right + np.where(copies > 1, 32, 0)).astype(np.uint64)
    digest = mix((row * _SPREAD[: row.shape[1]]).sum(axis=1, dtype=np.uint64))
    sort = np.argsort(digest, kind="stable")
    row, digest, copies = row[sort], digest[sort], copies[sort]
    new = np.concatenate([[True], (row[1:] != row[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(row))).astype("<u4")
    row, digest, copies = row[first], digest[first], copies[first]
    salt = (digest >> np.uint64(20)) % copies.astype(np.uint64)
    bucket = (mix(row[:, _REACH] + salt * _PLACE[2]) % np.uint64(buckets)).astype(np.int64)
    sort = np.argsort(bucket, kind="stable")
    row, n, bucket = row[sort], n[sort], bucket[sort]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], len(bucket))):
        own, shape = row[a:b, :-1], row[a:b, -1].astype(np.uint8)
        left, right = _shape(shape)
        place = np.arange(-_REACH, _REACH + 1)
        flat = own[(place >= -left[:, None]) & (place <= right[:, None])]
        yield int(bucket[a]), b"".join((np.uint32(b - a).tobytes(), shape.tobytes(), n[a:b].tobytes(), flat.astype("<u8").tobytes()))


def _shape(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and right of the pivot."""
    plain = (shape & 31).astype(np.int64)
    return plain // LONGEST, plain % LONGEST


def _mine(blobs: list[bytes], least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The phrases that these fragments' pivots own, as arrays of ids of equal length, with their counts.

    A phrase of a places left and b right of the pivot grows from the one without its last word, or, without a word
    to the right, from the one without its first. Phrases are numbered anew at each step, so a number and
    a word make an exact key. Pivots that are dealt out keep all phrases, as other buckets have more of them.
    """
    shapes, counts, flats = [], [], []
    for blob in blobs:
        m = int.from_bytes(blob[:4], "little")
        shapes.append(np.frombuffer(blob, np.uint8, m, 4))
        counts.append(np.frombuffer(blob, "<u4", m, 4 + m))
        flats.append(np.frombuffer(blob, "<u8", -1, 4 + 5 * m))
    shape, n, flat = np.concatenate(shapes), np.concatenate(counts).astype(np.int64), np.concatenate(flats)
    left, right = _shape(shape)
    pivot = np.cumsum(left + 1 + right) - right - 1
    bound = np.where(shape >= 32, 1, least)
    ids, code = np.unique(flat, return_inverse=True)
    code = code.reshape(-1).astype(np.int64)

    def word(k: int) -> np.ndarray:
        held = (k >= -left) & (k <= right)
        return np.where(held, code[np.where(held, pivot + k, 0)], -1)

    grown = {(0, 0): code[pivot]}
    phrases, totals = [], []
    for a in range(LONGEST):
        for b in range(LONGEST - a):
            if not a and not b:
                continue
            parent, last = (grown[a, b - 1], word(b)) if b else (grown[a - 1, 0], word(-a))
            alive = (parent >= 0) & (last >= 0)
            if a and b:
                alive &= grown[a - 1, b] >= 0
            rows = np.flatnonzero(alive)
            grown[a, b] = np.full(len(n), -1)
            if not len(rows):
                continue
            _, first, number = np.unique((parent[rows] << 32) | last[rows], return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, number, n[rows])
            kept = total >= bound[rows[first]]
            grown[a, b][rows] = np.where(kept[number], number, -1)
            if kept.any():
                example = pivot[rows[first[kept]]]
                phrases.append(ids[code[example[:, None] + np.arange(-a, b + 1)]])
                totals.append(total[kept])
    return phrases, totals


def _frequent_phrases(texts: DataFrame, levels: np.ndarray, buckets: int, least: int, seed: int, pivot_most: int) -> DataFrame:
    """words (ids), n: all phrases of two words or more that are frequent."""
    table = texts.sparkSession.sparkContext.broadcast(levels)  # MOST_BYTES at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = list(_fragments(_Words(part, seed), table.value, buckets, pivot_most))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "fragments"])

    def mine(group: pa.Table) -> pa.Table:
        phrases, totals = _mine(group.column("fragments").to_pylist(), least)
        kind = pa.list_(pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1).view(np.int64))) for p in phrases]
        return pa.table({"words": pa.chunked_array(lists, kind), "n": pa.chunked_array([pa.array(t) for t in totals], pa.int64())})

    sent = texts.mapInArrow(send, "bucket bigint, fragments binary")
    mined = sent.groupBy("bucket").applyInArrow(mine, "words array<bigint>, n bigint")
    return mined.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly: 128 bits hold both products up to 1e17 occurrences."""
    wide = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def collocations(documents: DataFrame, least: int = 100, top: int = 2000, bucket_words: int = BUCKET_WORDS, pivot_most: int = PIVOT_MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of the highest scores.

    `documents` has text and lang, other columns are left out. Texts are lower-cased (A-Z) and split into pieces at
    .,;:!? and line ends, those into words at blanks and tabs. A phrase is two to five words of a piece that stand
    together at least `least` times in the language (a, overlaps included). Cut in two it gives l and r, the counts of both
    parts, and a score floor(1000 * a * n / (l * r)), n being all words of the language; the cut of the lowest score
    counts, the earliest of several. Phrases inside a longer frequent one that is as frequent are left out.

    Null texts count as empty, null languages as `und`; repeated rows count each time; words and texts may have any
    length; ranks go by score, then a, both descending, then the phrase's bytes; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    scratch = Scratch(spark)
    for seed in range(100):
        words = scratch.keep(_count_words(texts, seed), f"words{seed}")
        shared = words.groupBy("id").agg(F.count("*").alias("words"), F.max("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            break
        scratch.drop(f"words{seed}")  # a frequent word shares its id with another: other hashes
    sizes = scratch.keep(words.groupBy("lang").agg(F.sum("n").alias("total")), "sizes")
    frequent = scratch.keep(words.where(F.col("n") >= least), "frequent")
    have, all_words = words.agg(F.count(F.when(F.col("n") >= least, 1)), F.sum("n")).first()
    scratch.drop(f"words{seed}")
    slots = min(max(1 << (BYTES_A_WORD * have).bit_length(), LEAST_BYTES), MOST_BYTES)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(all_words or 0) // bucket_words))
    phrases = scratch.keep(_frequent_phrases(texts, _levels(frequent, slots), buckets, least, seed, pivot_most), "phrases")

    # Every part of a frequent phrase is frequent, so its count is known.
    counts = phrases.union(frequent.select(F.array("id"), "n"))
    part = lambda name: counts.select(F.col("words").alias(f"{name}_words"), F.col("n").alias(name))
    size = F.size("words")
    cut = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"l_words": F.slice("words", F.lit(1), F.col("k")), "r_words": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(part("l"), "l_words").join(part("r"), "r_words")
    language = frequent.select(F.col("id").alias("first"), "lang")
    cut = scratch.keep(cut.withColumn("first", F.element_at("words", 1)).join(language, "first").join(sizes, "lang"), "cuts")
    scratch.drop("phrases")
    scored = cut.withColumn("score", _score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("words", "lang", "a", "total").agg(weakest).select("words", "lang", "a", F.col("total").alias("n"), "cut.l", "cut.r", "cut.score")
    # A longer phrase that is as frequent and has this one inside has it, or such a one, as all but its last or first word.
    inside = cut.where((F.col("k") == size - 1) & (F.col("l") == F.col("a"))).select(F.col("l_words").alias("words")).union(
        cut.where((F.col("k") == 1) & (F.col("r") == F.col("a"))).select("r_words"))
    left = best.join(inside.distinct(), "words", "left_anti")
    spelt = left.select("*", F.posexplode("words").alias("pos", "id")).join(frequent.select("id", "word"), "id")
    named = spelt.groupBy("words", "lang", "a", "n", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelling"))
    phrase = F.array_join(F.transform("spelling", lambda x: x["word"]), " ").alias("phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # Spark keeps each task's first `top` rows of a language before it brings them together.
    ranked = named.select("lang", phrase, "a", "l", "r", "n", "score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
