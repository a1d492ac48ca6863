"""Functions for SQL users, registered in a session.

SELECT doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS spans FROM documents) LATERAL VIEW explode(spans) AS s
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from lexweave.functions.patterns import PATTERNS, PatternSpec
from lexweave.functions.spans import _literal, find_sql

_KIND = "array<struct<entity_type:string,start:int,end:int,original:string>>"


def register(spark: SparkSession, specs: Sequence[PatternSpec] | None = None, profile: str = "rules") -> None:
    """pii_spans(text): all matches of a profile's patterns, or of given ones, with their types and offsets; pii_count(text)."""
    def found(spec: PatternSpec) -> str:
        return f"transform({find_sql('t', _literal(spec.pattern))}, s -> named_struct('entity_type', '{spec.entity_type}', 'start', s.start, 'end', s.end, 'original', s.original))"

    every = ", ".join(found(x) for x in (PATTERNS[profile] if specs is None else specs))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(t STRING) RETURNS {_KIND} RETURN CAST(concat({every}) AS {_KIND})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pii_count(t STRING) RETURNS INT RETURN size(pii_spans(t))")
