"""MinHash fingerprints of documents, and near-duplicate pairs by banded signatures.

A fingerprint holds, for each of PERMUTATIONS universal hash functions, the smallest value over the
document's five-word shingles, sixteen bits of each in hex. The share of equal places estimates the Jaccard
similarity of two shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, settle
from .textblocks import mix, shingle_hashes, shingle_sets, slices

PERMUTATIONS = 128
SEED = 20_240_901
EMPTY = np.uint16(0xFFFF)
EMPTY_TEXT = "f" * 4 * PERMUTATIONS


def permutations(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the multiply-add hash functions on 64-bit numbers."""
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**63, (2, count), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signatures(texts: pa.Array, count: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """The signature of every text (texts x count, 16 bits each); all ones for one without words."""
    hashes, at = shingle_hashes(texts)
    out = np.full((len(at) - 1, count), EMPTY, np.uint16)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    begins = at[:-1][some]
    mult, add = permutations(count, seed)
    least = np.empty((len(some), count), np.uint64)
    value = np.empty_like(hashes)
    for k in range(count):
        np.multiply(hashes, mult[k], out=value)
        value += add[k]
        least[:, k] = np.minimum.reduceat(value, begins)
    out[some] = (mix(least) >> np.uint64(48)).astype(np.uint16)  # the minimum's own top bits are nearly all zero
    return out


def as_text(signature: np.ndarray) -> list[str]:
    """Each signature in lowercase hex, four digits a place."""
    wide = signature.astype(">u2")
    return [row.tobytes().hex() for row in wide]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places, row by row; texts without words are like each other only."""
    return (a == b).mean(1)


def fingerprint_documents(documents: DataFrame, count: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint) for every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(as_text(signatures(part.column("text"), count, seed)), pa.string())], names=["doc_id", "fingerprint"]
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _with_next(documents: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, look, doc_id, text) dealt out by ranges of doc_id and sorted: each bucket's rows are followed
    by the first row of the next bucket that has rows, with look = true; the last bucket's by the first of all.

    Only the bucket borders and each bucket's least id come to the driver, four a partition.
    """
    base = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    borders = sorted(set(base.agg(F.percentile_approx("doc_id", shares, 20_000)).first()[0] or []))
    if not borders:
        return base.limit(0).select(F.lit(0).alias("bucket"), F.lit(False).alias("look"), "doc_id", "text")
    top = 1 << max(0, len(borders).bit_length() - 1)
    halvings = [top >> i for i in range(top.bit_length())]
    array = F.array(*[F.lit(b) for b in borders]) if len(borders) < 50 else F.from_json(F.lit(str(borders)), "array<bigint>")
    bucket = F.aggregate(  # binary search: how many borders are at most the id
        F.array(*map(F.lit, halvings)), F.lit(0),
        lambda found, step: F.when(F.coalesce(F.get(array, found + step - 1) <= F.col("doc_id"), F.lit(False)), found + step).otherwise(found),
    )
    held = base.withColumn("bucket", bucket)
    least = dict(held.select("bucket", "doc_id").groupBy("bucket").agg(F.min("doc_id")).collect())  # at most 4 * parts
    own = sorted(least)
    before = {b: own[i - 1] for i, b in enumerate(own)}  # the first follows the last
    firsts = F.from_json(F.lit(str([least.get(b, 0) for b in range(len(borders) + 1)])), "array<bigint>")
    ahead = F.from_json(F.lit(str([before.get(b, 0) for b in range(len(borders) + 1)])), "array<int>")
    to = F.when(
        F.get(firsts, F.col("bucket")) == F.col("doc_id"),
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("look")), F.struct(F.get(ahead, F.col("bucket")).alias("bucket"), F.lit(True).alias("look"))),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("look"))))
    dealt = held.select(F.explode(to).alias("to"), "doc_id", "text").select("to.bucket", "to.look", "doc_id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "look", "doc_id", "text")


def edited_fingerprints(documents: DataFrame, count: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending doc_id (after the last: the first). Null texts are empty; null ids come first, as one least id;
    rows of equal ids follow one another by text; an only row is its own next. An empty table gives an empty one.
    Other columns are left out.
    """
    spark = documents.sparkSession
    dealt = _with_next(documents, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row that still waits for its next: id, text, signature, bucket

        for batch in batches:
            for part in slices(batch, "text"):
                marks = signatures(part.column("text"), count, seed)
                rows = list(zip(part.column("bucket").to_pylist(), part.column("look").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist()))
                ready = []
                for i, (bucket, look, doc_id, text) in enumerate(rows):
                    if held is not None and held[3] == bucket:
                        ready.append((held, text, marks[i]))
                    held = None if look else (doc_id, text, marks[i], bucket)
                for at in range(0, len(ready), 512):
                    some = ready[at : at + 512]
                    edited = []
                    for (_, text, _, _), following, _ in some:
                        half = len(text) // 2
                        edited.append(text[: len(text) - half] + following[:half])
                    marks_e = signatures(pa.array(edited, pa.large_string()), count, seed)
                    own, nxt = np.stack([x[0][2] for x in some]), np.stack([x[2] for x in some])
                    ids = [None if x[0][0] == -(2**63) else x[0][0] for x in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64()), pa.array([len(x[0][1]) for x in some], pa.int64()),
                            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                            pa.array(as_text(own), pa.string()), pa.array(as_text(marks_e), pa.string()),
                            pa.array(likeness(own, marks_e), pa.float64()), pa.array(likeness(own, nxt), pa.float64()),
                        ],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    return dealt.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def near_duplicates(documents: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """Near-duplicate documents by signature bands, verified: (doc_id, class_id) of those that aren't the least of their class.

    Documents of equal signatures are one entry, so copies are never paired. Entries of a band bucket are paired with
    one of them first, and then, where that leaves several components, across components; each pair's exact Jaccard similarity over
    shingles is checked. Texts without words and rows without ids link with nothing. Banding finds a pair at the threshold with a
    chance of 1 - (1 - 0.8**5)**25, over 0.999.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.view(np.int64) for s in shingle_sets(part.column("text"))], pa.list_(pa.int64()))], names=["doc_id", "shingles"]
                )

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    prints = fingerprint_documents(ids).where(F.col("fingerprint") != EMPTY_TEXT)
    classes = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring("fingerprint", b * 4 * rows + 1, F.lit(4 * rows)))))
    buckets = settle(classes.select(F.col("doc_id").alias("id"), band.alias("bucket")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.where("a < b").distinct())
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        shingles = settle(ids.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles array<bigint>").dropDuplicates(["doc_id"]))
        x, y = (shingles.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        return settle(pairs.join(x, "a").join(y, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b"))

    # Each member of a bucket with one of them, drawn by a hash; then members that are still in different components.
    heads = buckets.groupBy("bucket").agg(F.min_by("id", F.xxhash64("bucket", "id")).alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    links = verified(buckets.join(heads, "bucket").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")))
    known = connected_components(links).withColumnRenamed("node", "id")
    placed = settle(buckets.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    rest = placed.join(apart, "bucket")
    pairs = rest.alias("x").join(rest.alias("y"), "bucket").where("x.component < y.component").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    known = connected_components(links.union(verified(pairs)))
    named = classes.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fingerprint", F.coalesce("component", "doc_id").alias("class_id"))
    return prints.join(settle(named), "fingerprint").where("doc_id <> class_id").select("doc_id", "class_id")
