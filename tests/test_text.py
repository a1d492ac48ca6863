import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions import vocabulary as v
from lexweave.functions.patterns import RULES_PATTERNS, TOKENS_PATTERNS
from lexweave.functions.spans import find_spans, resolve_overlaps
from lexweave.operators.detect import NO_SPANS


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalisers(spark):
    assert column(spark, ["  a \t b\n", None], tx.collapse_spaces) == ["a b", ""]
    assert column(spark, [' «Ромашка», ', '("x")'], tx.clean_entity) == ["Ромашка", "x"]
    assert column(spark, ["Straße", "ИВАНОВ  И."], tx.normal_key) == ["strasse", "иванов и."]
    assert column(spark, ["Общества с ограниченной ответственностью «А»"], tx.canonical_org) == ["общество с ограниченной ответственностью «а"]
    assert column(spark, ["﻿a  \r\nb\r\n\r\n\r\n\r\nc  \n"], tx.normalize_text) == ["a\nb\n\nc"]
    assert column(spark, ["кратко", "   ", None, "x" * 500_001, "достаточно длинный текст"], tx.typed_text_error) == ["too_short", "empty", "empty", "too_long", None]
    assert column(spark, [" отчёт 1.pdf ", "", None], tx.safe_filename) == ["1.pdf", "report", "report"]


def test_quality(spark):
    assert column(spark, ["???? ????", "обычный текст", "а б в г д е", "�" * 3 + "abc", "  "], tx.looks_corrupted) == [True, False, True, True, False]
    assert column(spark, ["ab 1", "?"], tx.quality_score) == [6.0, -6.0]
    assert column(spark, [["???", "читаемый", "читаемый"]], tx.best_text, "array<string>") == ["читаемый"]


@pytest.mark.parametrize("pattern", [r"\d+", "аб", r"\b\w\b"])
def test_find_spans_is_finditer(spark, pattern):
    texts = ["x 12 yy 345", "", "аб аб😀аб 1 а", "1", "12", " нет "]
    got = column(spark, texts, lambda x: find_spans(x, "(?U)" + pattern))
    want = [[(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for t in texts]
    assert [[tuple(s) for s in g] for g in got] == want


def matches(spark, kind, text, patterns=RULES_PATTERNS):
    return [s["original"] for p in patterns if p.entity_type == kind for s in column(spark, [text], lambda x, p=p: find_spans(x, p.pattern))[0]]


@pytest.mark.parametrize("kind, text, want", [
    ("ДАТА", "12.05.2021", ["12.05.2021"]), ("ДАТА", "25/06/2023", ["25/06/2023"]), ("ДАТА", "5 января 2021 года", ["5 января 2021 года"]), ("ДАТА", "12 МАРТА 2020 г.", ["12 МАРТА 2020 г."]),
    ("ДАТА", "32.05.2021", []), ("ПРИЦЕП_НОМЕР", "АА123477", ["АА123477"]), ("ГОСНОМЕР", "Е567КМ199", ["Е567КМ199"]), ("НОМЕР_ДЕЛА", "дело А40-12345/2020", ["А40-12345/2020"]),
    ("НОМЕР_ДЕЛА", "1-23/21", ["1-23/21"]), ("БИК", "123456789", []), ("VIN", "1HGBH41JXMN10918", []), ("БАНК_СЧЁТ", "1234567890123456789", []),
    ("АДРЕС", "119019, г. Москва, ул. Арбат, д. 12, кв. 5", "119019, г. Москва, ул. Арбат, д. 12, кв. 5"), ("АДРЕС", "дер. Ласково, д. 7", "дер. Ласково, д. 7"),
    ("АДРЕС", "119019,\nг. Москва,\nул. Арбат, д. 12", "119019,\nг. Москва,\nул. Арбат, д. 12"), ("АДРЕС", "Согласно ст. 15 ГК РФ ответчик обязан возместить убытки.", []),
    ("АДРЕС", "жил на улице Тверской долго", "на улице Тверской"),
])
def test_formats(spark, kind, text, want):
    got = matches(spark, kind, text)
    assert (got[:1] == [want]) if isinstance(want, str) else got == want


def test_token_formats(spark):
    assert matches(spark, "INN", "ИНН 1234567890 и 123456789", TOKENS_PATTERNS) == ["1234567890"]
    assert matches(spark, "SNILS", "12345678900 и 123-456-789 00", TOKENS_PATTERNS) == ["123-456-789 00"]


def naive(spans, rules):
    ranks = {"ner": 0, "dict": 1, "regex": 2} if rules else {"llm": 0, "manual": 0, "dict": 1, "regex": 2}
    rank = lambda s: ranks.get(s[2], 3)
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], rank(s))):
        hit = next((i for i, k in enumerate(kept) if s[0] < k[1] and s[1] > k[0]), None)
        if hit is None:
            kept.append(s)
            continue
        k = kept[hit]
        a, b = (s[1] - s[0], -rank(s), s[3] if rules else 0), (k[1] - k[0], -rank(k), k[3] if rules else 0)
        if a > b:
            kept[hit] = s
    return sorted(kept)


@pytest.mark.parametrize("profile", ["rules", "tokens"])
def test_resolve_is_the_naive_rule(spark, profile):
    import random

    rng = random.Random(5)
    cases = []
    for _ in range(300):
        n = rng.randrange(0, 9)
        spans = [(a, a + rng.randrange(1, 12), rng.choice(["ner", "dict", "regex", "rule", "llm", "manual"]), rng.choice([0.5, 0.9])) for a in (rng.randrange(0, 30) for _ in range(n))]
        cases.append(spans)
    rows = [(i, [(a, b, "T", str(k), src, conf, None, k) for k, (a, b, src, conf) in enumerate(spans)]) for i, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, s {NO_SPANS}")
    for r in df.select("i", resolve_overlaps(F.col("s"), profile).alias("r")).collect():
        assert [(s["start"], s["end"], s["source"], s["confidence"]) for s in r["r"]] == naive(cases[r["i"]], profile == "rules")


def test_partial_overlap_leak_is_optional(spark):
    df = spark.createDataFrame([([(0, 10, "T", "a", "regex", 1.0, None, 0), (5, 20, "T", "b", "regex", 1.0, None, 1)],)], f"s {NO_SPANS}")
    r = df.select(resolve_overlaps(F.col("s")).alias("a"), resolve_overlaps(F.col("s"), leak_safe=True).alias("b")).first()
    assert [(s["start"], s["end"]) for s in r["a"]] == [(5, 20)]
    assert [(s["start"], s["end"]) for s in r["b"]] == [(0, 20)]


def test_vocabulary_forms():
    role = re.compile(v.any_form(v.ROLES).removeprefix("(?U)"))
    assert all(role.match(w) for w in ("истец", "истца", "ответчику", "стороны", "гражданин", "гражданки", "продавцом"))
    assert not role.match("иванов")
    assert {"Иванович", "Сергеевна", "Дмитриевич", "Ильинична"} <= set(v.patronymics())
