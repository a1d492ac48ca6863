"""Dictionaries as tries against the plain search of each text."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexweave.functions.phrases import Phrases, Words
from lexweave.operators import detect

DATA = "/root/testdata/sf0.001"


def hard_texts(n=300, seed=5):
    rng = random.Random(seed)
    parts = ["Иван", "Иванов", "иван", "Toyota", "toyota", "camry", "land", "cruiser", "машина", "d'été", "«Lada»", "x-trail", "_a_", "3", "—", "…", "İstanbul", "😀", "áb", "ab,cd", "(Пётр)", "Пётр,", " ", "\n", "\t"]
    return ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\n", ", ", ""]) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", None, " ", "a" * 50_000, "Иван " * 4000]


def test_words_are_those_of_the_pattern():
    texts = hard_texts()
    words = Words(texts)
    got = [[] for _ in texts]
    for row, start, stop in zip(words.row, words.start, words.stop):
        got[row].append((int(start), int(stop)))
    assert got == [[m.span() for m in re.finditer(r"\b\S+\b", t or "")] for t in texts]
    assert len(Words([]).begin) == 0 and len(Words([None, ""]).begin) == 0


def test_found_phrases_are_those_of_the_set():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    phrases = {" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))) for _ in range(150)} | {"", "a, b", "w1 ", "один два"}
    known = Phrases(sorted(phrases))
    texts = [" ".join(rng.choice([*vocabulary, "W3", "zz", "Один", "два"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    words = Words(texts)
    found = known.found(words)
    for i in range(len(words.begin)):
        row = words.row[i]
        for n in (1, 2, 3):
            own = [k for k in range(i, min(i + n, len(words.begin))) if words.row[k] == row]
            said = " ".join(texts[row][words.start[k] : words.stop[k]].lower() for k in own)
            want = len(own) == n and said in phrases
            assert (found[i, n - 1] >= 0) == want and (not want or known.phrase(int(found[i, n - 1])) == said)
    assert (Phrases([]).found(words) == -1).all() and len(Phrases([])) == 0


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_columns_against_the_plain_search(spark, monkeypatch, limit):
    """Both as tries in every task and by a join; equal and null ids don't matter."""
    monkeypatch.setattr(detect, "MAX_BROADCAST_ROWS", limit)
    texts = hard_texts()
    names, vehicles = ["Иван", "Иванов", "Пётр", "Toyota", "İstanbul"], ["toyota", "toyota camry", "land cruiser", "lada", "x-trail", "toyota land cruiser", "camry"]
    table = lambda words: spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "phrase string")
    df = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = detect.with_both(df, "v", "n", table(vehicles), table(names)) if limit > 1 else detect.with_names(detect.with_vehicles(df, "v", table(vehicles)), "n", table(names))
    near = re.compile(f"(?i)(?={detect.v.alternatives(tuple(detect.v.VEHICLE_CONTEXT))})")
    show = lambda spans: [(s["start"], s["end"], s["original"], s["confidence"]) for s in spans]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r["text"] or ""
        assert show(r["v"]) == show(detect._vehicle_runs(text, set(vehicles), near, 120))
        assert show(r["n"]) == show(detect._name_runs(text, set(names)) if re.search("[А-ЯЁ][а-яё]", text) else [])


def test_a_million_phrases(spark):
    """One trie of a million phrases, read by each task; those of them that texts hold are found, and no others."""
    phrases = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id") % 5000, F.lit(" v"), F.col("id")).alias("phrase"))
    texts = [(k, f"машина w{k % 5000} v{k} и W{(k + 1) % 5000} v{k}, w{(k + 5000) % 5000} V{k + 5000}") for k in range(0, 900_000, 4500)]
    out = detect.with_vehicles(spark.createDataFrame(texts, "doc_id long, text string"), "s", phrases)
    for r in out.collect():
        k = r["doc_id"]
        assert [s["original"] for s in r["s"]] == [f"w{k % 5000} v{k}", f"w{(k + 5000) % 5000} V{k + 5000}"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_query_over_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    phrases = set()
    for t in texts.values():
        words = re.findall(r"\b\S+\b", t.lower())
        phrases |= {" ".join(words[:n]) for n in (1, 2, 3) if len(words) >= n}
    near = re.compile("(?i)(?=en)")
    want = {(d, s["start"], s["end"]) for d, t in texts.items() for s in detect._vehicle_runs(t, phrases, near, 40)}
    assert {(r["doc_id"], r["start_at"], r["end_at"]) for r in entry.queries()["dictionary_phrases"](spark, DATA).collect()} == want and want


def test_lookups_take_texts_in_portions(monkeypatch):
    """As many spans as before whatever the portions, no portion beyond the limit but for single texts, and few bytes a span."""
    texts = hard_texts(2000)
    for limit in (1, 700, 10**9):
        monkeypatch.setattr(detect, "LETTERS_AT_ONCE", limit)
        ranges = list(detect._portions(pa.array(texts)))
        assert [i for b, e in ranges for i in range(b, e)] == [*range(len(texts))]
        assert all(e == b + 1 or sum(len((t or "").encode()) for t in texts[b:e]) <= limit for b, e in ranges)
    assert list(detect._portions(pa.array([], pa.string()))) == [(0, 0)]
    known = Phrases(["Иван", "Иванов", "Toyota"], False)
    spans = detect._names_of(texts, np.ones(len(texts), bool), Words(texts, known.seed), known)
    assert isinstance(spans, pa.Array) and spans.nbytes < 60 * len(spans.flatten()) + 8 * len(texts)
    want = [[{k: s[k] for k in ("start", "end", "original")} for s in detect._name_runs(t or "", {"Иван", "Иванов", "Toyota"})] for t in texts]
    assert spans.to_pylist() == want
