"""Similarity and differing lines against difflib, which tests alone use."""

import os
import random
import time
from difflib import SequenceMatcher
from itertools import pairwise

import pytest

import __spark_entry__ as entry
from lexweave.functions import blocks
from lexweave.operators import compare


def pairs(n, seed=0):
    rng = random.Random(seed)
    for k in range(n):
        letters = ["ab", "abcdefgh ", "абвгдежзийклмнопрстуфхцчшщъыьэюя ,.😀"][k % 3]
        size = rng.choice([0, 1, 5, 50, 199, 200, 201, 700])
        a = "".join(rng.choice(letters) for _ in range(size))
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(20)] = [rng.choice(letters) for _ in range(rng.randrange(20))]
        yield a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randrange(300)))


def plain_blocks(a, b):
    return [tuple(x) for x in SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]


@pytest.mark.parametrize("many", [-1, 300, 200_000])
def test_blocks(monkeypatch, many):
    """The same blocks whichever way segments are searched."""
    monkeypatch.setattr(blocks, "MANY_PAIRS", many)
    for a, b in pairs(150 if many < 0 else 300):
        assert blocks.matching_blocks(*blocks.coded(a, b)) == plain_blocks(a, b), (a, b)


@pytest.mark.parametrize("many", [-1, 200_000])
def test_lines(monkeypatch, many):
    monkeypatch.setattr(blocks, "MANY_PAIRS", many)
    rng = random.Random(6)
    for size in (0, 3, 40, 250, 900):
        for kinds in (3, 60, 5000):
            a = [f"line {rng.randrange(kinds)}" for _ in range(size)]
            b = [x for x in a if rng.random() > 0.1] + [f"line {rng.randrange(kinds)}" for _ in range(rng.randrange(9))]
            assert blocks.differences(a, b) == [tuple(o) for o in SequenceMatcher(None, a, b).get_opcodes() if o[0] != "equal"]


def test_long_texts_take_linear_memory_and_little_time():
    """Texts at the limit of a document, of which the plain way would look at over a hundred million pairs."""
    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(120)]
    a = "".join(rng.choices(letters, k=150_000))
    b = a[:70_000] + "x" * 500 + a[70_000:149_000]
    began = time.time()
    assert blocks.ratio(a, b) == 2 * 149_000 / (len(a) + len(b))
    assert time.time() - began < 60


def test_columns(spark):
    rows = [*pairs(60, 4), (None, None), (None, "x"), ("", None), ("one\n\n two\r\nthree\x0bfour", "one\ntwo\n3"), ("a" * 900 + "\nb", "c")]
    df = spark.createDataFrame(rows, "l string, r string").select("l", "r", compare.similarity("l", "r").alias("s"), compare.line_diff("l", "r").alias("d"))
    for r in df.collect():
        a, b = r["l"] or "", r["r"] or ""
        assert r["s"] == (round(SequenceMatcher(None, a, b).ratio(), 4) if a or b else 1.0)
        x, y = ([line.strip() for line in t.splitlines() if line.strip()] for t in (a, b))
        want = [(t, "\n".join(x[i:j])[:800], "\n".join(y[k:m])[:800]) for t, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes() if t != "equal"][:12]
        assert [tuple(d) for d in r["d"]] == want


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_over_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = entry.queries()["compare_cases_texts"](spark, DATA).collect()
    assert {r["left_id"] for r in rows} == {d for d in texts if d + 1 in texts}
    for r in rows:
        assert r["similarity"] == round(SequenceMatcher(None, texts[r["left_id"]], texts[r["right_id"]]).ratio(), 4)
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want = {(c, a[0]): round(SequenceMatcher(None, a[2], b[2]).ratio(), 4) for c, own in turns.items() for a, b in pairwise(sorted(own))}
    assert {(r["conv_id"], r["turn"]): r["similarity"] for r in entry.queries()["turn_similarity"](spark, DATA).collect()} == want


def test_documents_take_a_few_milliseconds():
    """Steps grow with what can be in a run, not with the letters of every segment: Python's own operations are counted, not time."""
    import sys

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", [8, 2, 3, 4, 12, 2, 2, 6, 7, 1, 1, 4, 2, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], k=rng.randrange(2, 9))) for _ in range(800)]
    a, b = (" ".join(rng.choices(words, k=500)) for _ in "ab")
    for text in (a, "a" * 300, "ab" * 200, "abc" * 90 + "x"):
        assert blocks.ratio(text, text) == SequenceMatcher(None, text, text).ratio() == 1.0
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    found = blocks.matching_blocks(*blocks.coded(a, b))
    sys.settrace(before)
    assert found == plain_blocks(a, b) and lines < 2 * (len(a) + len(b)), lines
