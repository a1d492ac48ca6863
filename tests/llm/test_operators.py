"""The training-data operators against brute force on small fixtures, odd inputs included."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat_format, common, embedding_dedup, fingerprints, line_dedup, mixing, ngram_join, packing, quality_crf, substring_dedup, url_filter
from lexweave.llm.queries import tokenizer_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, repeated lines, shared passages, odd ones."""
    rng = random.Random(3)
    texts = []
    passage = " ".join(words(rng, 60, 10**6)) + "."
    for i in range(60):
        lines = [" ".join(words(rng, rng.randrange(1, 40))) + "." for _ in range(rng.randrange(1, 8))]
        texts.append("\n".join(lines))
    base = " ".join(words(rng, 150, 5000))
    for k in range(25):  # a group of near copies, most of them different
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 12 + ["", None, "  \n\t", "one two", "One TWO", "one two three four five", "ß é 漢字 😀", "x" * 3000, "a b " * 2000]
    for k in range(6):
        texts.append(" ".join(words(rng, 30, 10**6)) + ". " + passage + " " + " ".join(words(rng, 20, 10**6)) + ".")
    return texts


def frame(spark, texts):
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    want = components(600, edges)
    got = dict(tuple(r) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6_against_brute_force(spark, corpus):
    sets = [shingles(t) for t in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    docs = frame(spark, corpus).withColumn("n", F.lit(1)).withColumn("set", F.lit("x"))
    rows = ngram_join.jaccard_components(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_op6_rtree_and_prefixes():
    rng = np.random.default_rng(0)
    points = rng.poisson(2, (300, ngram_join.GROUPS)).astype(np.uint8)
    points[50:80] = points[0] + (rng.integers(0, 2, (30, ngram_join.GROUPS)) * rng.integers(0, 2, (30, 1))).astype(np.uint8)
    sizes = points.sum(1, dtype=np.int64)
    tree = ngram_join.RTree(points, sizes)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(1, dtype=np.int64)
        want = np.flatnonzero((bound >= ngram_join.least_overlap(sizes[i], sizes)) & (100 * sizes >= 80 * sizes[i]) & (100 * sizes[i] >= 80 * sizes))
        assert sorted(tree.search(points[i], sizes[i])) == sorted(want)
    for n in range(1, 200):
        ahead, behind = ngram_join.prefix_sizes(n)
        assert 1 <= behind <= ahead <= n


def test_op6_cross_components_in_cells(spark):
    """Pairs that only the second round finds: members of a cell whose head links with neither."""
    shared = [f"r{i}" for i in range(8)]
    a = shared + [f"a{i}" for i in range(40)]
    texts = [" ".join(shared + [f"h{i}" for i in range(36)]), " ".join(a), " ".join(a + ["tail"])]
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert out == {0: 0, 1: 1, 2: 1}


def test_op6_very_long_near_copies(spark):
    """Sets whose group counts pass a byte: their bound must not rule them out."""
    words_of = [f"u{i}" for i in range(100_004)]
    texts = [" ".join(words_of), " ".join(words_of[:-1] + ["tail"]), " ".join(f"v{i}" for i in range(100_004)), "one two three four five"]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert out == {0: (100_000, 0), 1: (100_000, 0), 2: (100_000, 2), 3: (1, 3)}


def test_op6_rtree_of_very_long_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 90_000).astype(np.uint64)
    sets = [np.concatenate([base[k * 10 :], rng.integers(0, 2**63, k * 10).astype(np.uint64)]) for k in range(200)]
    sets += [rng.integers(0, 2**63, n).astype(np.uint64) for n in (90_000, 40_000, 300)]
    points = ngram_join._unpacked([ngram_join._point(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    assert (points.sum(1, dtype=np.int64) == sizes).all()
    found = ngram_join.RTree(points, sizes).search(points[0], 90_000)
    assert set(range(200)) <= set(found.tolist()) and not {201, 202} & set(found.tolist())


def line_sets(text):
    for i, line in enumerate((text or "").split("\n") if text is not None else []):
        s = frozenset(w for w in re.sub("[\t\r\x0b\x0c]", " ", line).lower().split(" ") if w)
        if s:
            yield i, s


def test_op3_against_brute_force(spark, corpus):
    every = [(d, i, s) for d, t in enumerate(corpus) for i, s in line_sets(t)]
    gone = {(d, i) for k, (d, i, s) in enumerate(every) if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in every[:k])}
    docs = frame(spark, corpus)
    rows = line_dedup.repeated_lines(docs, Fraction(4, 5)).collect()
    assert len(rows) == len(gone) and {(r["doc_id"], r["line_no"]) for r in rows} == gone
    at = {(d, i): s for d, i, s in every}
    for r in rows:
        a, b = at[r["doc_id"], r["line_no"]], at[r["kept_doc_id"], r["kept_line_no"]]
        assert (r["kept_doc_id"], r["kept_line_no"]) < (r["doc_id"], r["line_no"])
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in enumerate(corpus):
        lines = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone]
        had = any(k == d for k, _, _ in every)
        if had and not any(s for _, s in line_sets("\n".join(lines))):
            assert d not in kept
        else:
            assert kept[d] == (None if t is None else "\n".join(lines))
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", ["10MB", "256k"])
def test_op3_every_partner_in_hot_groups(spark, threshold):
    """Lines that share their rarest words: each goes for the earliest of all that are similar, not for one of a few."""
    texts = [" ".join([*(f"h{i}" for i in range(9)), f"own{k}"]) for k in range(150)]
    every = [frozenset(x.split()) for x in texts]
    want = {}
    for k, s in enumerate(every):
        near = [i for i in range(k) if 5 * len(s & every[i]) >= 4 * len(s | every[i])]
        same = [i for i in range(k) if s == every[i]]
        if near:
            want[k] = (same or near)[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = line_dedup.repeated_lines(frame(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["kept_doc_id"] for r in rows} == want and len(rows) == len(want)


def test_op3_no_line_pairs_with_itself(spark):
    """A class that stands twice in a group, as two of its words share 31 bits."""
    rows = [(1, 0, 1, 0, 10, 7, 7, [5, 5, 6]), (2, 3, 2, 3, 10, 7, 7, [5, 5, 6])]
    classes = spark.createDataFrame(rows, "doc_id long, line_no int, x_doc_id long, x_line_no int, n long, bits long, half_bits long, rare array<int>")
    assert {tuple(r) for r in line_dedup._by_prefix(classes, Fraction(4, 5)).collect()} == {(2, 3, 1, 0)}


def test_op3_sketches_by_size(spark):
    """An earliest line of another size doesn't keep near copies from meeting the earliest of their own size."""
    rows = [(0, 0, 5, 0, None, 1, 9, [100])] + [(k, 0, 60, 0, 0, 1, 9, [200 + k]) for k in range(1, 8)]
    classes = spark.createDataFrame(rows, "doc_id long, line_no int, n long, bits long, half_bits long, low long, high long, rare array<int>")
    assert {tuple(r) for r in line_dedup._by_sketch(classes, Fraction(4, 5)).collect()} == {(k, 0, 1, 0) for k in range(2, 8)}


@pytest.mark.parametrize("threshold", ["-1", "64k", "256k", "10m"])
def test_op3_groups_stay_whole(spark, threshold):
    """The same links however joins are planned: near copies of many groups, and copies of all of them."""
    rng = random.Random(11)
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(20)]
        for k in range(12):
            w = list(base)
            for j in rng.sample(range(20), k % 3):
                w[j] = f"e{g}x{k}y{j}"
            texts.append(" ".join(w))
    sets = [frozenset(t.split()) for t in texts]
    want = {}
    for k, s in enumerate(sets):
        near = [i for i in range(k) if 5 * len(s & sets[i]) >= 4 * len(s | sets[i])]
        if near:
            want[k] = near[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = line_dedup.repeated_lines(frame(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["kept_doc_id"] for r in rows} == want and len(rows) == len(want)


def test_op3_odd_rows(spark):
    """Null ids and texts, repeated rows, other white space, case, one very long line, clashing columns, empty tables."""
    long = " ".join(f"u{i}" for i in range(60_000))
    rows = [(1, "A b\tC  d e\n\n \t"), (1, "A b\tC  d e\n\n \t"), (2, " e d c B a"), (None, "a b c d e"), (3, None), (4, ""), (5, long), (6, long + " tail"), (7, "É é x y z"), (8, "é É x y z")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, line_no int, _text string, _gone int")
    found = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], round(r["similarity"], 4)) for r in line_dedup.repeated_lines(docs).collect()}
    assert found == {(2, 0): (1, 0, 1.0), (6, 0): (5, 0, round(60_000 / 60_001, 4)), (8, 0): (7, 0, 1.0)}
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["line_no"], r["_text"], r["_gone"]) for r in kept.collect()) == sorted(
        (i or 0, t or "", 1, "x", 2) for i, t in rows if i not in (2, 6, 8))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_op3_one_id_with_different_texts(spark):
    """Lines belong to rows, not to ids: what resembles nothing stays."""
    rows = [(0, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta eta"), (1, "one two three four five six seven"), (1, "one two three four five six seven"),
            (2, "first line here\nalpha beta gamma delta epsilon zeta"), (2, "second line there\none two three four five six seven"), (2, "own words only"), (None, "own words only"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "'x' AS digest").repartition(3)
    left = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert left == sorted([(0, rows[0][1]), (1, rows[2][1]), (1, rows[2][1]), (2, "first line here"), (2, "second line there"), (2, "own words only"), (None, "own words only"), (2, None)], key=str)


def test_op9_one_id_with_different_texts(spark):
    passage = "This passage of quite a few words stands in two rows of one id."
    rows = [(0, passage), (1, f"Before it. {passage} After it."), (1, "x" * 400), (1, f"Other words. {passage}"), (1, f"Other words. {passage}"), (None, passage), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _cuts", "'x' AS text_id").repartition(3)
    left = substring_dedup.remove_passages(docs, 5)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        [(0, passage), (1, "Before it.  After it."), (1, "x" * 400), (1, "Other words. "), (1, "Other words. "), (None, passage), (2, None)], key=str)


def test_op8_one_id_with_different_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (4, [0.0, 1.0]), (7, [-1.0, 0.0]), (None, [-1.0, 0.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("a")))
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == sorted([(5, 1, 5), (5, 1, 4), (6, 1, 5), (4, 1, 4), (7, 1, 7), (None, 1, 7)], key=str)


def brute_passages(texts, least):
    seen, out = {}, []
    for d, t in enumerate(texts):
        run = []
        for k, (a, b, n, digest) in enumerate(substring_dedup.units_of(t or "")):
            if digest in seen:
                if run and run[-1][0] == k - 1:
                    run.append((k, a, b, n))
                else:
                    out.append((d, run))
                    run = [(k, a, b, n)]
            seen.setdefault(digest, (d, k))
        out.append((d, run))
    return {(d, r[0][1], r[-1][2]) for d, r in out if r and sum(x[3] for x in r) >= least}


def test_op9_against_brute_force(spark, corpus):
    docs = frame(spark, corpus)
    rows = substring_dedup.repeated_passages(docs, 25).collect()
    assert {(r["doc_id"], r["start"], r["stop"]) for r in rows} == brute_passages(corpus, 25)
    shared = [len(corpus) - k for k in range(5, 0, -1)]
    assert set(shared) <= {r["doc_id"] for r in rows}  # the passage inside lines of different texts
    for r in rows:
        assert corpus[r["doc_id"]][r["start"]] not in " \n"
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs, 25).collect()}
    assert len(cut) == len(corpus) and all(len(cut[d]) < len(corpus[d]) for d in shared)
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_op9_units():
    text = "Pi is 3.14 now. Next one!  Last\n\nline"
    assert [text[a:b] for a, b, _, _ in substring_dedup.units_of(text)] == ["Pi is 3.14 now.", "Next one!", "Last", "line"]


def test_op2_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_start|>", "plain", "", None, "<|im_start|", "a<|im_end|>\n", "<", "|", "\\", "50%\n<b>", "😀<|im_end|>"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, 0, "us\ner<|im_start|>%0A", "x"), (2, 1, None, None), (2, None, "assistant", "n"), (None, 1, "assistant", "q"), (2, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0)).withColumn("source", F.lit(""))
    out = {r["conv_id"]: r for r in chat_format.format_conversations(turns).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(hard)]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("assistant", "n"), ("us\ner<|im_start|>%0A", "x"), ("", ""), ("", "")]
    assert out[1]["escaped_turns"] == 5
    for r in out.values():
        said = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert [m["text"] for m in r["mask"]] == said
        for m in r["mask"]:
            piece = r["formatted"][m["start"] : m["start"] + m["length"]]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", piece) == m["text"]
    d = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_conversations(turns)).collect()}
    body = "".join(("assistant" if k % 2 else "user") + "\n" + (t or "") + "\n" for k, t in enumerate(hard))
    assert d[1]["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest() and d[1]["formatted_chars"] == len(out[1]["formatted"])
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_op10_packing(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [*corpus, "a<|endoftext|>b <|endoftext|>", "it's  \n\n  I'll 12345 ñandú"]
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(texts)}
    rows = packing.pack_documents(frame(spark, texts), tokenizer_path(), portion=20_000).collect()
    held, sequences = {i: [] for i in ids}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(piece) > 0
        held[r["doc_id"]].append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places, total in [(held[i], len(ids[i])) for i in ids] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 1024
    used = sum(map(len, ids.values()))
    assert len(sequences) <= used / 1024 + 10
    assert packing.pack_documents(frame(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_op10_balance():
    rng = random.Random(0)
    lengths = [rng.choice([5, 60, 300, 700, 1024, 2500]) for _ in range(2000)]
    pieces = packing.assign(lengths)
    totals, costs = Counter(), Counter()
    for i, _, n, q, _ in pieces:
        totals[q] += n
        costs[q] += packing.cost(n)
    assert sum(totals.values()) == sum(lengths) and max(totals.values()) <= 1024 and len(totals) == -(-sum(n % 1024 for n in lengths) // 1024) + sum(n // 1024 for n in lengths)
    assert len(pieces) < 2 * len(lengths)
    open_ = [c for q, c in costs.items() if q >= sum(n // 1024 for n in lengths)]
    assert max(open_) < 1.5 * np.mean(open_)


def test_op10_rule_by_brute_force():
    """Every tail, longest first, in the cheapest of all sequences with room for it, not of a few."""
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randrange(1, 1500) for _ in range(rng.randrange(1, 120))]
        whole = sum(n // 1024 for n in lengths)
        tails = sorted(((n % 1024, i, n - n % 1024) for i, n in enumerate(lengths) if n % 1024), key=lambda t: (-t[0], t[1]))
        room = {whole + k: 1024 for k in range(-(-sum(t[0] for t in tails) // 1024))}
        costs = dict.fromkeys(room, 0.0)
        want = []
        while tails:
            n, i, start = tails.pop(0)
            able = [q for q in room if room[q] >= n] or [q for q in room if room[q]]
            q = min(able, key=lambda q: (costs[q], q))
            part = min(n, room[q])
            want.append((i, start, part, q, 1024 - room[q]))
            costs[q] += packing.cost(part)
            room[q] -= part
            if part < n:
                tails.insert(0, (n - part, i, start + part))
        assert [p for p in packing.assign(lengths) if p[3] >= whole] == want


def test_op10_any_text(spark):
    """Texts that the fast encoder gives up on, and that it agrees on the driver's documents with the slow one."""
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = [" " * 1_500_000, "\n" * 1_200_000 + "x", "a" * 300_000]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), tokenizer_path()).collect()
    for i, text in enumerate(odd):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n, _ in own] == [c for _, _, c in own] and sum(n for _, n, _ in own) == len(ids)
    if os.path.isdir("/root/testdata/sf0.001"):
        encode = packing._encoder(tokenizer_path())
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
            assert encode(r[0] or "").tolist() == t.encode(r[0] or "", add_special_tokens=False).ids


def test_op5_fingerprints(spark, corpus):
    docs = frame(spark, corpus)
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(rows) == len(corpus)
    errors = []
    for i, t in enumerate(corpus):
        t, following = t or "", corpus[(i + 1) % len(corpus)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", following)):
            a, b = shingles(t), shingles(other)
            errors.append(rows[i][column] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    assert rows[3]["fingerprint"] != rows[4]["fingerprint"] and len({rows[i]["fingerprint"] for i, t in enumerate(corpus) if t == corpus[0]}) == 1
    only = fingerprints.edited_fingerprints(docs.where("doc_id = 3")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


def test_op5_near_duplicates(spark, corpus):
    sets = [shingles(t) for t in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(frame(spark, corpus)).collect()}
    assert all(want[d] == want[c] for d, c in got.items())
    grouped = {i for i, c in enumerate(want) if c != i}
    assert len(grouped & set(got)) >= 0.9 * len(grouped)


def test_op8_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 40, 200)] + rng.normal(size=(200, 16)) * 0.15
    vectors = np.concatenate([base, near, np.repeat(base[:2], 15, 0)]).astype(np.float32)
    labels = [int(x) for x in rng.integers(0, 3, len(vectors))]
    rows = [(i, [float(x) for x in v], labels[i]) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]
    rows += [(n + k, e, 0) for k, e in enumerate(odd)] + [(n + 10, rows[0][1], None)]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(link, False)
    found = sum(out[i]["n_links"] for i in range(n))
    assert 0.97 * link.sum() <= found <= link.sum() and all(out[i]["n_links"] <= link[i].sum() for i in range(n))
    want = components(n, [(a, b) for a, b in zip(*np.nonzero(link)) if b < a])
    assert np.mean([out[i]["component_id"] == want[i] for i in range(n)]) > 0.97
    assert all(out[i]["component_id"] == i and out[i]["n_links"] == 0 and out[i]["kept"] for i in [*range(n, n + 6), n + 10])


def test_op7_cascade(spark):
    urls = ["https://a.org/x", "http://example.org/es/1?q", "https://www.EXAMPLE.org/en/12#t", "https://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://q.net", "ftp://spam-farm.example.net/en",
            "nourl", None, "://", "http://xorg/", "http://org", "http://org/", "http://notexample.org/es/", "http://x.com/fr", "http://a..org/"] + [f"http://h{i}.net/{i}" for i in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "block" if host in url_filter.LISTED_HOSTS else "allow"))
        return host, path, best[1], best[2]

    for i, u in enumerate(urls):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == brute(u), u
    listed = spark.createDataFrame([(f"H{i}.net",) for i in range(0, 3000, 3)], "host string")
    blocked = {r["page_id"] for r in url_filter.filter_urls(pages, listed_hosts=listed).where("verdict = 'block' and rule is null").collect()}
    assert blocked == {17 + i for i in range(0, 3000, 3)}  # exact, false positives included
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_op4_budgets(spark, corpus):
    docs = frame(spark, [t for t in corpus for _ in range(3)])
    plan = mixing.MixPlan(weights={"lang": {"en": 3.0, "de": 1.0}, "source": {"src1": 0.0}}, budget_share=0.9, max_epochs=2, seed=1)
    rows = mixing.mix(docs.withColumn("tokens", F.lit("x")), plan).collect()
    tokens = {r["doc_id"]: -(-len((r["text"] or "").encode()) // 4) for r in docs.collect()}
    assert not any(r["source"] == "src1" for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["lang"], r["source"]), []).append(r)
        assert 0 <= r["taken"] <= r["tokens"] == tokens[r["doc_id"]]
    total = sum(r["taken"] for r in rows)
    assert total == pytest.approx(0.9 * sum(tokens.values()), abs=len(by) + 1)
    for leaf in by.values():
        cut = [r for r in leaf if r["taken"] < r["tokens"]]
        assert len(cut) <= 1  # a prefix ends in one document
        epochs = Counter((r["doc_id"], r["epoch"]) for r in leaf)
        assert max(epochs.values()) == 1
    again = mixing.mix(docs.repartition(3), plan).select("doc_id", "epoch", "taken").collect()
    assert {tuple(x) for x in again} == {(r["doc_id"], r["epoch"], r["taken"]) for r in rows}
    assert mixing.mix(docs.limit(0), plan).count() == 0


def test_op4_odd_rows(spark):
    """Columns that clash with names used inside, null levels, repeated rows, empty texts, a very long one."""
    rows = [(1, "abcd" * 10, "en", None), (1, "abcd" * 10, "en", None), (2, None, None, "s"), (3, "", "en", "s"), (4, "é" * 200_000, "de", "s"), (None, "abcd", "en", "s")]
    clash = ["slices", "wanted", "border", "before", "here", "to", "_l", "_s", "_order", "_slice", "_0", "available", "a.b"]
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in clash))
    out = mixing.mix(docs, mixing.MixPlan(budget_share=1.0, max_epochs=1))
    assert out.columns == [*docs.columns, "domain", "epoch", "tokens", "taken"]
    got = [r.asDict() for r in out.collect()]
    assert all([r[c] for c in clash] == list(range(len(clash))) for r in got)
    assert Counter(r["doc_id"] for r in got if r["tokens"]) == {1: 2, 4: 1, None: 1} and sum(r["taken"] for r in got) == 20 + 100_000 + 1


def test_op4_cut_to(spark):
    rows = [("héllo wörld", 1), ("héllo", 9), ("", 1), ("😀😀", 1), ("a😀😀", 1), ("aé漢😀", 2), (None, 1), ("abc", 0)]
    out = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "i int, t string, n long").select("i", mixing.cut_to(F.col("t"), F.col("n")).alias("c"))
    for r in out.collect():
        t, n = rows[r["i"]]
        want = None if t is None else next(t[:k] for k in range(len(t), -1, -1) if len(t[:k].encode()) <= 4 * n)
        assert r["c"] == want


def test_op4_shortages_go_to_siblings_first(spark):
    rows = [("hub", "en", "src0", 1, 100.0), ("hub", "en", "b", 1, 1000.0), ("hub", "de", "c", 1, 1000.0), ("even", "en", "d", 1, 5000.0)]
    leaves = spark.createDataFrame([(d, lang, s, n, int(a)) for d, lang, s, n, a in rows], "domain string, lang string, source string, docs long, available long")
    plan = mixing.MixPlan(budget_share=0.5, max_epochs=1)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, plan).collect()}
    assert got == {"src0": 100, "b": 787, "c": 887, "d": 1775}  # 3550 in halves; src0's shortage goes to b alone


def test_op1_quality(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(words(rng, rng.randrange(5, 25))).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    bad = [lambda: " ".join(f"{w}&&&" for w in words(rng, 60)), lambda: " | ".join(words(rng, 60)), lambda: (rng.choice("abc") + "word ") * 60, lambda: "The start is fine here.\n" + "!! ".join(w.upper() for w in words(rng, 60))]
    rows = [(i, good() if i % 4 else rng.choice(bad)(), int(bool(i % 4))) for i in range(800)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(1000, "", 0.0), (1001, None, 0.0), (1002, "x" * 200_000, 0.0), (None, "a b", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality_crf.score_documents(docs, model).collect()}
    assert len(out) == 804 and all(0 <= r["score"] <= 1 for r in out.values())
    held = [(out[i]["predicted"], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert quality_crf.fit(docs, labels.where("quality = 1")) is None
    assert {r["predicted"] for r in quality_crf.score_documents(docs, None).collect()} == {1}


def test_op1_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    emit, steps, first = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    marginal, pairs, norm = quality_crf.forward_backward(emit, steps, first)
    want, want_pairs, want_norm = np.zeros((7, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        weights = []
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            weights.append((y, np.exp(sum(emit[a + k, v] for k, v in enumerate(y)) + sum(steps[u, v] for u, v in zip(y, y[1:])))))
        z = sum(w for _, w in weights)
        want_norm += np.log(z)
        for y, w in weights:
            for k, v in enumerate(y):
                want[a + k, v] += w / z
            for u, v in zip(y, y[1:]):
                want_pairs[u, v] += w / z
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(norm, want_norm)


def test_queries_against_sql(spark):
    import os

    import duckdb

    from lexweave.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, data)
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        order = sorted(columns)
        got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
        assert got == sorted(tuple(str(r[columns.index(c)]) for c in order) for r in found.fetchall()), name


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator says on its own input; clean documents stay."""
    import corpus_pipeline as p

    rng = random.Random(9)
    clean = ["\n".join(" ".join(words(rng, 12, 10**6)).capitalize() + "." for _ in range(5)) for _ in range(40)]
    junk = [" ".join(f"{w}&&&" for w in words(rng, 80)) for _ in range(12)]
    near = [clean[0].replace("\n", " zz\n", 1) + f"\nown{k} line{k} here{k}" for k in range(3)]
    texts = clean + junk + [clean[1]] * 2 + near
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40)) for i in range(52)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"] for r in docs.collect()})
        if k < 4:
            assert docs.columns == DOCUMENTS.replace(" long", "").replace(" string", "").split(", ")
    assert set(range(40)) <= kept[0] and not kept[0] & set(range(40, 52))
    assert set(range(40)) <= kept[1] and not kept[1] & {52, 53}
    assert set(range(40)) <= kept[2]
    assert kept[3] < kept[2] and kept[4] == kept[3]
    assert p.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_near_duplicates_of_repeated_rows(spark, tmp_path):
    """One row of each group stays; a text isn't lost because its id comes with another text as well."""
    import corpus_pipeline as p

    long, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, long), (1, long), (2, long), (3, other), (3, third), (3, third + " x"), (4, other), (5, ""), (5, ""), (6, None), (None, long), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
    out = p.near_duplicate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in out.collect()))
    assert got == [(0, "a0"), (0, "a0"), (1, "a0"), (3, "b0"), (3, "c0"), (5, ""), (6, "")]
