"""Corpus metrics against plain counts."""

import random

from lexweave.operators import evaluate

SPANS = "doc_id long, entity_type string, start int, end int"


def test_maps_by_group(spark):
    rows = [("a", {"PER": ["Иванов  И.", "иванов и.", "Пётр"], "АДРЕС": ["ул. Мира, 5"]}, {"PER": ["ИВАНОВ И."], "АДРЕС": ["г. Омск, ул. Мира, 5", "Томск"]}), ("a", None, {"PER": ["Лев"]}), ("b", {"ORG": ["Ромашка"]}, None), (None, {}, {})]
    df = spark.createDataFrame(rows, "lang string, expected map<string,array<string>>, entities_found map<string,array<string>>")
    out = {(r["lang"], r["entity_type"]): tuple(r)[2:] for r in evaluate.precision_recall(df, by=("lang",)).collect()}
    assert out["a", "PER"] == (2, 2, 1, 0.5, 0.5) and out["a", "АДРЕС"] == (1, 2, 1, 0.5, 1.0)
    assert out["b", "ORG"] == (1, 0, 0, None, 0.0) and out[None, "ORG"] == (0, 0, 0, None, None) and len(out) == 9
    assert evaluate.precision_recall(df.limit(0)).count() == 0


def plain(expected, found):
    """One row a pair of spans that are each other's best."""
    shared = lambda e, f: min(e[3], f[3]) - max(e[2], f[2]) if e[:2] == f[:2] and None not in e else 0
    best = lambda x, others, flip: min(((-s, o[2], o[3]) for o in others if (s := shared(*((o, x) if flip else (x, o)))) > 0), default=None)
    out = set()
    for e in expected:
        for f in found:
            s = shared(e, f)
            if s > 0 and best(e, found, False) == (-s, f[2], f[3]) and best(f, expected, True) == (-s, e[2], e[3]):
                out.add((*e, f[2], f[3], s))
    return out


def test_spans_are_matched_one_to_one(spark):
    rng = random.Random(4)

    def spans(n):
        return [(rng.choice([1, 2, None]), rng.choice(["A", "B"]), at, at + rng.choice([0, 1, 5, 70, 300])) for at in (rng.randrange(600) for _ in range(n))] + [(1, "A", None, 5), (1, "A", 9, 4)]

    expected, found = spans(120), spans(150)
    e, f = (spark.createDataFrame(x, SPANS).selectExpr("*", "1 AS bin", "'x' AS shared").repartition(3) for x in (expected, found))
    good = lambda rows: {r for r in rows if None not in r and r[3] > r[2]}
    want = plain(good(expected), good(found))
    for width in (1, 7, 64, 10_000):
        assert {tuple(r) for r in evaluate.matched_spans(e, f, width=width).collect()} == want
    rates = {r["entity_type"]: r for r in evaluate.span_precision_recall(e, f).collect()}
    for kind in "AB":
        n = [sum(1 for r in {x for x in rows if x[2] is not None and x[3] > x[2]} if r[1] == kind) for rows in (expected, found)]
        correct = sum(1 for r in want if r[1] == kind)
        assert tuple(rates[kind]) == (kind, *n, correct, correct / n[1], correct / n[0])
    exact = {r["entity_type"]: r["correct"] for r in evaluate.span_precision_recall(e, e, exact=True).collect()}
    assert exact == {k: sum(1 for r in good(expected) if r[1] == k) for k in "AB"}
    assert evaluate.span_precision_recall(e.limit(0), f.limit(0)).count() == 0
