"""Comparing two cases: similarity, differing lines, laws and practice on one side only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.blocks import differences, ratio


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The share of two texts that is in their matching blocks, to four digits; 1 if both are empty; nulls are empty."""
    return pd.Series([round(ratio(a or "", b or ""), 4) for a, b in zip(left, right)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "left", "right")])))
def line_diff(left: pd.Series, right: pd.Series) -> pd.Series:
    """Differing runs of stripped, non-empty lines: 800 characters a side, twelve at most."""
    def diff(a: str, b: str) -> list[dict]:
        x, y = ([line.strip() for line in (t or "").splitlines() if line.strip()] for t in (a, b))
        return [{"type": kind, "left": "\n".join(x[i:j])[:800], "right": "\n".join(y[k:m])[:800]} for kind, i, j, k, m in differences(x, y)[:12]]

    return pd.Series([diff(a, b) for a, b in zip(left, right)])


def only_left(left: Column, right: Column, keys: tuple[str, ...], most: int = 10) -> Column:
    """Items of `left` whose keys no item of `right` has, in order, repeats kept, ten at most; missing keys count as empty."""
    none = F.lit("")
    key = lambda item: F.concat_ws("\u0001", *[F.coalesce(item[k], none) for k in keys])
    there = F.transform(F.coalesce(right, F.array()), key)
    return F.slice(F.filter(left, lambda item: ~F.coalesce(F.array_contains(there, key(item)), F.lit(False))), 1, most)


def compare_cases(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """pairs (left_id, right_id) with similarities, lengths, highlights and what is on one side only.

    cases: id, filename, created_at, status, source, anonymized_text, original_text, legal_summary, recommendations, relevant_laws, court_practice. A case that isn't there
    leaves its pair out.
    """
    text = F.coalesce(F.nullif("anonymized_text", F.lit("")), F.col("original_text"), F.lit(""))
    side = cases.select("id", F.struct(
        F.struct("id", "filename", "created_at", "status", "source").alias("meta"), text.alias("text"), F.coalesce("legal_summary", F.lit("")).alias("summary"),
        F.coalesce("recommendations", F.lit("")).alias("recommendations"), "relevant_laws", "court_practice").alias("c"))
    both = pairs.join(side.select(F.col("id").alias("left_id"), F.col("c").alias("l")), "left_id").join(side.select(F.col("id").alias("right_id"), F.col("c").alias("r")), "right_id")
    return both.select(
        "left_id", "right_id", F.col("l.meta").alias("left_case"), F.col("r.meta").alias("right_case"),
        similarity("l.text", "r.text").alias("similarity"), F.length("l.text").alias("left_length"), F.length("r.text").alias("right_length"), line_diff("l.text", "r.text").alias("highlights"),
        similarity("l.summary", "r.summary").alias("summary_similarity"), similarity("l.recommendations", "r.recommendations").alias("recommendations_similarity"),
        only_left(F.col("l.relevant_laws"), F.col("r.relevant_laws"), ("title", "article")).alias("laws_only_left"),
        only_left(F.col("r.relevant_laws"), F.col("l.relevant_laws"), ("title", "article")).alias("laws_only_right"),
        only_left(F.col("l.court_practice"), F.col("r.court_practice"), ("case", "court")).alias("practice_only_left"),
        only_left(F.col("r.court_practice"), F.col("l.court_practice"), ("case", "court")).alias("practice_only_right"),
    )
