"""Precision and recall of detected entities against expected ones, over a corpus, by any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import normal_key

#: Spans are joined by bins of so many characters.
BIN = 64


def _rates(correct_found: Column, found: Column, correct_expected: Column, expected: Column) -> list[Column]:
    return [(correct_found / F.nullif(found, F.lit(0))).alias("precision"), (correct_expected / F.nullif(expected, F.lit(0))).alias("recall")]


def precision_recall(results: DataFrame, expected: str = "expected", found: str = "entities_found", types: tuple[str, ...] = ("PER", "ORG", "АДРЕС"), by: Sequence[str] = ()) -> DataFrame:
    """(by..., entity_type, expected, found, correct, precision, recall) from map<type, texts> columns.

    Distinct normalised texts count; of an address it is enough that one is a part of the other. A null map holds
    nothing; every type has a row in each group; a rate without a denominator is null. One aggregate, whatever the number of groups.
    """
    def names(column: str, kind: str) -> Column:
        return F.array_distinct(F.transform(F.coalesce(F.try_element_at(F.col(column), F.lit(kind)), F.array().cast("array<string>")), normal_key))

    def counted(kind: str) -> Column:
        e, f = names(expected, kind), names(found, kind)
        if kind == "АДРЕС":
            like = lambda a, others: F.exists(others, lambda b: F.contains(a, b) | F.contains(b, a))
            hit_e, hit_f = F.size(F.filter(e, lambda a: like(a, f))), F.size(F.filter(f, lambda a: like(a, e)))
        else:
            hit_e = hit_f = F.size(F.array_intersect(e, f))
        return F.struct(F.lit(kind).alias("entity_type"), F.size(e).alias("ne"), F.size(f).alias("nf"), hit_e.alias("he"), hit_f.alias("hf"))

    rows = results.select(*by, F.inline(F.array(*map(counted, types))))
    total = rows.groupBy(*by, "entity_type").agg(*(F.sum(c).alias(c) for c in ("ne", "nf", "he", "hf")))
    return total.select(*by, "entity_type", F.col("ne").alias("expected"), F.col("nf").alias("found"), F.col("he").alias("correct"),
                        *_rates(F.col("hf"), F.col("nf"), F.col("he"), F.col("ne")))


def matched_spans(expected: DataFrame, found: DataFrame, same: Sequence[str] = ("doc_id", "entity_type"), width: int = BIN) -> DataFrame:
    """Pairs of an expected and a found span that match: same..., start, end, found_start, found_end, shared.

    Both tables have the columns `same`, whose values have to be equal and not null, and start, end. Two spans match if each is the
    other's best: the one with the most characters in common, of several the first by start, then end. So each has one
    match at most. Equal rows of one table are one span. The join goes by bins of offsets, in which only spans
    that lie near each other meet; a long span is in many of them.
    """
    def binned(spans: DataFrame, name: str) -> DataFrame:
        own = spans.where((F.col("end") > F.col("start")) & F.col("start").isNotNull()).select(*same, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias(name)).distinct()
        return own.withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"{name}.start") / width), F.floor((F.col(f"{name}.end") - 1) / width))))

    shared = F.least("e.end", "f.end") - F.greatest("e.start", "f.start")
    meeting = F.greatest(F.floor(F.col("e.start") / width), F.floor(F.col("f.start") / width)) == F.col("bin")  # of the bins that both are in, the first
    pairs = binned(expected, "e").join(binned(found, "f"), [*same, "bin"]).where(meeting).withColumn("shared", shared).where("shared > 0")
    best = lambda mine, other: F.row_number().over(Window.partitionBy(*same, mine).orderBy(F.desc("shared"), other))
    chosen = pairs.withColumns({"of_e": best("e", "f"), "of_f": best("f", "e")}).where("of_e = 1 and of_f = 1")
    return chosen.select(*same, "e.start", "e.end", F.col("f.start").alias("found_start"), F.col("f.end").alias("found_end"), "shared")


def span_precision_recall(expected: DataFrame, found: DataFrame, same: Sequence[str] = ("doc_id", "entity_type"), by: Sequence[str] = ("entity_type",), exact: bool = False, width: int = BIN) -> DataFrame:
    """(by..., expected, found, correct, precision, recall) of spans matched one to one; with `exact` those of equal offsets match.

    `by` names columns of `same`. Groups that either table has are there; empty tables give no rows.
    """
    one = lambda spans, e, f, c: spans.select(*by, F.lit(e).alias("e"), F.lit(f).alias("f"), F.lit(c).alias("c"))
    distinct = lambda spans: spans.where((F.col("end") > F.col("start")) & F.col("start").isNotNull()).select(*same, "start", "end").distinct()
    pairs = distinct(expected).join(distinct(found), [*same, "start", "end"]) if exact else matched_spans(expected, found, same, width)
    every = one(distinct(expected), 1, 0, 0).union(one(distinct(found), 0, 1, 0)).union(one(pairs, 0, 0, 1))
    total = every.groupBy(*by).agg(F.sum("e").alias("expected"), F.sum("f").alias("found"), F.sum("c").alias("correct"))
    return total.select(*by, "expected", "found", "correct", *_rates(F.col("correct"), F.col("found"), F.col("correct"), F.col("expected")))
