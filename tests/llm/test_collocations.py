"""Collocations against a plain count of all phrases, odd rows included."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import collocations as co


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = set()
    for lang, own in counts.items():
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        hidden = set()
        for q, f in frequent.items():
            for m in range(2, len(q)):
                hidden |= {q[i : i + m] for i in range(len(q) - m + 1) if 100 * f >= 100 * frequent[q[i : i + m]]}
        scored = []
        for p, a in frequent.items():
            score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if p not in hidden:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "ÉTÉ", "été", "naïve", "漢字", "x\xa0y", "😀", "a-very-long-word-of-over-eight-bytes", "a-very-long-word-of-over-eight-bytez"]
    passage = "the quick brown fox, jumps over the LAZY dog; again and again and again and again"
    out = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!? "]) for _ in range(rng.randrange(60)))
        out.append((text + (passage if i % 3 == 0 else ""), ["en", "EN", "de", None, "und"][i % 5]))
    return out + [("a a a a a a a " * 30, "en"), ("", "en"), (None, None), (" .,\t", "fr"), ("one", "fr"), ("b" * 100_000 + " c " * 500, "de")]


def found(df, **options):
    return {tuple(r) for r in co.collocations(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"bucket_words": 200, "pivot_most": 1 << 20}, {"bucket_words": 100, "pivot_most": 7}])
def test_against_brute_force(spark, rows, options):
    """Also with many buckets, and with pivots dealt out over several."""
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS words", "2 AS id", "3 AS bucket").repartition(5)
    assert found(df, least=4, **options) == brute(rows, 4, 2000)


def test_ranks_end_at_the_top(spark, rows):
    """The first rows are chosen before languages come together, so no task gets all of a language."""
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert found(df, least=6, top=5) == brute(rows, 6, 5)
    plan = co.collocations(df, least=6, top=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_and_nothing_frequent(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    assert co.collocations(df.limit(0)).count() == 0
    assert co.collocations(df, least=10**6).count() == 0


def test_any_order_of_rarity_will_do(spark, rows, monkeypatch):
    """A table of frequent words that is full tells nothing, and loses nothing."""
    monkeypatch.setattr(co, "LEAST_BYTES", 2)
    monkeypatch.setattr(co, "MOST_BYTES", 2)
    assert found(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=4) == brute(rows, 4, 2000)


def test_other_hashes_where_ids_are_shared(spark, rows, monkeypatch):
    real, seeds = co._count_words, []

    def shared(texts, seed):
        seeds.append(seed)
        counted = real(texts, seed)
        return counted.withColumn("id", F.when(F.col("word").isin("w1", "w2"), 5).otherwise(F.col("id"))) if seed == 0 else counted

    monkeypatch.setattr(co, "_count_words", shared)
    assert found(spark.createDataFrame(rows, "text string, lang string"), least=4) == brute(rows, 4, 2000)
    assert seeds == [0, 1]


def test_scores_are_exact(spark):
    rng = random.Random(1)
    rows = [(10**13 - 7, 10**16 + 3, 10**13, 10**13 - 1), (100, 10**15, 10**9 + 7, 123), (3, 7, 2, 5)]
    rows += [(rng.randrange(1, 10**12), rng.randrange(10**12, 10**16), rng.randrange(10**12, 10**13), rng.randrange(10**12, 10**13)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(co._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_each_occurrence_has_one_pivot():
    """Fragments of one bucket hold each phrase around its pivot once, however often the pivot comes in it."""
    import pyarrow as pa

    part = pa.record_batch({"text": ["a b a b a", "a a a"], "lang": ["en", "en"]})
    words = co._Words(part, 0)
    blobs = [b for _, b in co._fragments(words, np.full(2, 8, np.uint8), 3, 1 << 20)]
    total = Counter()
    for blob in blobs:
        for phrases, n in zip(*co._mine([blob], 1)):
            for p, c in zip(phrases, n):
                total[len(p)] += int(c)
    assert total == {2: 4 + 2, 3: 3 + 1, 4: 2, 5: 1}
