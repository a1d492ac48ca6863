"""Patterns of vocabularies with common first letters factored out, and asked for within lambdas."""

import re

from pyspark.sql import functions as F

from lexweave.functions import vocabulary as v
from lexweave.operators import rules

SETS = {k: getattr(v, k) for k in ("ROLES", "BODIES", "COURTS", "CODES", "GENERIC", "TABLE_HEADERS", "ORG_KEYWORDS", "ALIAS_PREFIXES")}
ENDS = ["", "а", "у", "ом", "ем", "е", "ы", "и", "ов", "ей", "ам", "ами", "ах", "я", "ю", "ь", "ого", "ему", "ым", "ая", "ую", "ой", "ий", "ый", "ин", "ине", "ца", " "]


def test_factored_patterns_match_the_same_words():
    every = tuple(x for s in SETS.values() for x in s)
    words = {x[:k] + e for x in every for k in range(1, len(x) + 1) for e in ENDS} | {"день", "дню"}
    for lemmas in (*SETS.values(), every):
        plain = re.compile("^(?:" + "|".join(v.forms(x) for x in dict.fromkeys(lemmas)) + ")$")
        quick = re.compile(v.any_form(lemmas).removeprefix("(?U)"))
        assert [w for w in words if bool(plain.search(w)) != bool(quick.search(w))] == []


def test_no_pattern_is_compiled_for_each_value(spark):
    """rlike within a lambda compiles its pattern for each value."""
    rows = spark.range(1).select(F.lit("истец Марс").alias("t"), F.lit("Марс").alias("o"))
    decided = rows.select(rules.decide_person(F.col("t"), F.lit(6), F.lit(10), F.col("o"), F.lit(0.95)).alias("d"))
    assert "RLIKE" not in decided._jdf.queryExecution().analyzed().toString().upper()
    assert decided.first()["d"]["reason"] == "single_token_with_context"
    odd = spark.createDataFrame([("",), (None,), ("аб\n",), ("аб",)], "x string").select(*[(F.col("x").rlike(p).eqNullSafe(rules._like(F.col("x"), p))) for p in ("^$", "^(?:аб)$", "б", "^", r"(?U)^\s*$")])
    assert all(all(r) for r in odd.collect())
