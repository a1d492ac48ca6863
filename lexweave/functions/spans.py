"""Spans inside one text: finding, overlap resolution, replacement. Offsets are code points from 0.

Everything is a column expression over arrays of a document's own spans, so plans stay narrow: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,original:string>>"


def column(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_sql(t: str, p: str) -> str:
    """find_spans as SQL, of the SQL expressions of a text and a pattern."""
    hits = f"regexp_extract_all({t}, {p}, 0)"
    ends = (f"aggregate(arrays_zip({hits}, split({t}, {p}, -1)), named_struct('at', 0, 'out', CAST(array() AS array<int>)), (acc, z) -> IF(z.`0` IS NULL, acc, named_struct("
            "'at', acc.at + length(z.`1`) + length(z.`0`), 'out', concat(acc.out, array(acc.at + length(z.`1`) + length(z.`0`))))), acc -> acc.out)")
    found = f"transform(arrays_zip({hits}, {ends}), z -> named_struct('start', z.`1` - length(z.`0`), 'end', z.`1`, 'original', z.`0`))"
    return f"CASE WHEN regexp_like({t}, {p}) THEN CAST({found} AS {PLACE}) ELSE CAST(array() AS {PLACE}) END"


def find_spans(text: str | Column, pattern: str | Column) -> Column:
    """All matches of a pattern, left to right, not overlapping: array<struct<start,end,original>>.

    The pattern must not match the empty string. The pieces between matches give the offsets. With a column's name and a
    constant pattern the same expression is parsed from SQL, which takes far fewer calls to build.
    """
    if isinstance(text, str) and isinstance(pattern, str):
        return F.expr(find_sql(f"`{text}`", _literal(pattern)))
    text = column(text)
    expr = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, expr, F.lit(0))
    gaps = F.split(text, expr, -1)
    # The fold keeps numbers only, as it copies what it has gathered at each match.
    ends = F.aggregate(
        F.arrays_zip(hits.alias("hit"), gaps.alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, z: F.when(z["hit"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + F.length(z["gap"]) + F.length(z["hit"]))).alias("out"),
        )),
        lambda acc: acc["out"],
    )
    walk = F.transform(F.arrays_zip(hits.alias("hit"), ends.alias("end")), lambda z: F.struct(
        (z["end"] - F.length(z["hit"])).alias("start"), z["end"].alias("end"), z["hit"].alias("original"))).cast(PLACE)
    # Most texts have no match: one search settles that, before anything is cut.
    return F.when(F.regexp_like(text, expr), walk).otherwise(F.array().cast(PLACE))


def overlaps(start: Column, end: Column, others: Column) -> Column:
    """Whether [start, end) shares a character with any of others (array of start, end)."""
    return F.exists(others, lambda o: (start < o["end"]) & (end > o["start"]))


#: Which source wins between spans of equal length; others come last.
PRIORITY = {"rules": {"ner": 0, "dict": 1, "regex": 2}, "tokens": {"llm": 0, "manual": 0, "dict": 1, "regex": 2}}


def resolve_overlaps(spans: Column, profile: str = "rules", leak_safe: bool = False) -> Column:
    """Disjoint spans by start, from spans (start, end, entity_type, original, source, confidence, identity_key, ordinal).

    Spans are taken by start, longest first. Of two that overlap the longer one stays, of equal ones that of the better
    source, then (profile rules) of the higher confidence, then the earlier one. Accepted spans are disjoint and come by start, so only the last accepted one can be in the way:
    the rule is a fold. With leak_safe a span that gives way keeps covering what the winner doesn't: the winner is widened.
    """
    rank = F.lit(3)
    sorted_spans = F.array_sort(F.transform(
        F.filter(spans, lambda s: s["end"] > s["start"]),
        lambda s: F.struct(
            s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"),
            _ranked(s["source"], PRIORITY[profile], rank).alias("rank"), s["ordinal"].alias("ordinal"), s["end"].alias("end"),
            s["entity_type"].alias("entity_type"), s["original"].alias("original"), s["source"].alias("source"), s["confidence"].alias("confidence"), s["identity_key"].alias("identity_key")),
    ))
    kind = "array<struct<start:int,shorter:int,rank:int,ordinal:int,end:int,entity_type:string,original:string,source:string,confidence:double,identity_key:string>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        better = (s["shorter"] < last["shorter"]) | ((s["shorter"] == last["shorter"]) & (s["rank"] < last["rank"]))
        if profile == "rules":
            better = better | ((s["shorter"] == last["shorter"]) & (s["rank"] == last["rank"]) & (s["confidence"] > last["confidence"]))
        winner, loser = s, last
        if leak_safe:
            wide = lambda a, b: a.withField("start", F.least(a["start"], b["start"])).withField("end", F.greatest(a["end"], b["end"]))
            winner, loser = wide(s, last), wide(last, s)
        replaced = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.when(better, winner).otherwise(loser)))
        return F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(s))).otherwise(replaced)

    return F.aggregate(sorted_spans.cast(kind), F.array().cast(kind), step)


def _ranked(source: Column, ranks: dict[str, int], other: Column) -> Column:
    out = other
    for name, rank in ranks.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def replace_spans(text: Column, spans: Column, token) -> Column:
    """The text with each of disjoint, ordered spans replaced by token(span)."""
    walk = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), token(s)).alias("out")),
    )
    done = lambda w: F.concat(w["out"], F.substring(text, w["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(F.array(walk), done), 1))
