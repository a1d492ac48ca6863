"""Substring deduplication by hashing lines, cut into sentences, with original offsets.

Units are the sentences of every line (a passage often begins or ends inside a line, but always holds
whole sentences). Units are normalised and hashed, digests are grouped globally, and the earliest occurrence
by (doc_id, unit) is kept. Later occurrences that follow one another are one passage; passages of MIN_WORDS words
or more are removed, with their offsets in the original text. Shorter ones are common phrases and stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle
from .textblocks import slices

MIN_WORDS = 25
_UNIT = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)")
_SCHEMA = "doc_id long, text_id long, unit int, start int, stop int, words int, digest binary"


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of every unit with a letter or digit; offsets are code points.

    Case and runs of white space don't count for the digest; a unit's offsets hold its closing mark.
    """
    out = []
    begin = 0
    for m in _UNIT.finditer(text):
        stop = m.end()
        closed = stop == len(text) or text[stop - 1] == "\n" or (text[stop - 1] in ".!?" and text[stop : stop + 1].isspace())
        if not closed and stop < len(text):
            continue  # a mark inside a word, as in 3.14
        words = text[begin:stop].lower().split()
        if words:
            lead = len(text[begin:stop]) - len(text[begin:stop].lstrip())
            out.append((begin + lead, begin + len(text[begin:stop].rstrip()), len(words), hashlib.blake2b(" ".join(words).encode(), digest_size=12).digest()))
        begin = stop
        if stop >= len(text):
            break
    return out


def document_units(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, unit, start, stop, words, digest) of all units; null texts have none, rows without an id are left out.

    text_id is a hash of the text, which tells different texts of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                columns = (part.column(c).to_pylist() for c in ("doc_id", "text_id", "text"))
                rows = [(d, h, i, *u) for d, h, t in zip(*columns) for i, u in enumerate(units_of(t or ""))]
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "text_id", "unit", "start", "stop", "words", "digest"])

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text")).where("doc_id is not null").mapInArrow(run, _SCHEMA)


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a removed passage: doc_id, start, stop, words, units, kept_doc_id, kept_start.

    start and stop are code points of the document's own text; kept_doc_id and kept_start tell where the earliest
    occurrence of the passage's first unit stands. Rows of equal id and text are kept or cut alike and count once; different
    texts of one id are documents of their own, in the order of a hash of the text. A repeat within one document
    counts too. Empty and null texts give nothing, an empty table an empty one.
    """
    return _passages(documents, min_words).drop("text_id")


def _passages(documents: DataFrame, min_words: int) -> DataFrame:
    """repeated_passages() with text_id."""
    units = document_units(documents)
    place = F.struct("doc_id", "text_id", "unit", "start")
    # Only digests that occur again matter; the aggregate is partial, so a unit's copies meet before the shuffle.
    # Settled, so that Spark can split the partition of a very frequent unit in the join.
    again = settle(units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first"))
    later = units.join(again, "digest").where(place != F.col("first"))
    # Neighbouring units have the same difference of unit and rank.
    rank = F.row_number().over(W.partitionBy("doc_id", "text_id").orderBy("unit", "start", "stop"))
    runs = later.dropDuplicates(["doc_id", "text_id", "unit", "start", "stop"]).withColumn("run", F.col("unit") - rank)
    return (
        runs.groupBy("doc_id", "text_id", "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").cast("long").alias("words"), F.count("*").alias("units"),
             F.min(F.struct("unit", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"))).alias("kept"))
        .where(F.col("words") >= min_words)
        .select("doc_id", "text_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "words", "units",
                F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").cast("long").alias("kept_start"))
    )


def remove_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated passages cut out of text; all other columns as they are, nothing left out."""
    own = {c: f"_lexweave_{c}" for c in ("id", "text_id", "cuts")}  # names that no table has
    cuts = _passages(documents, min_words).groupBy(F.col("doc_id").alias(own["id"]), F.col("text_id").alias(own["text_id"])).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(own["cuts"]))
    ends = F.concat(F.transform(own["cuts"], lambda c: c["start"]), F.array(F.length("text").cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(own["cuts"], lambda c: c["stop"]))
    kept = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda z: F.substring(
        F.col("text"), (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int"))), "")
    same = (F.col("doc_id").cast("long") == F.col(own["id"])) & (F.xxhash64(F.col("text").cast("string")) == F.col(own["text_id"]))
    cut = F.when(F.col(own["cuts"]).isNull(), F.col("text")).otherwise(kept).alias("text")
    return documents.join(cuts, same, "left").select(*[cut if c == "text" else F.col(c) for c in documents.columns])
