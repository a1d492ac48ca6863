"""The whole transform: detect, resolve, render. Narrow in its plan, but for dictionaries too large for every task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.spans import replace_spans, resolve_overlaps
from lexweave.operators import detect, render, rules


def candidates(documents: DataFrame, profile: str = "rules", dictionaries: bool = True, names=None, vehicles=None, ner: str | None = None, llm: str | None = None) -> DataFrame:
    """documents (text, ...) with `candidates`, and for profile rules review_candidates and whitelist_skipped. Ids play no part.

    names, vehicles: tables or lists in place of the small default dictionaries. ner: a column of recogniser candidates. llm: a column of replies of a
    language model. Null texts are empty.
    """
    out = documents.withColumn("text", F.coalesce("text", F.lit("")))
    parts = []
    if profile == "rules":
        out = rules.refine(out, "text", ner)
        parts.append(F.col("rule_spans"))
    if dictionaries:
        out = detect.with_both(out, "_vehicles", "_names", vehicles, names)
        own = F.concat("_vehicles", "_names")
        if profile == "tokens":  # the other profile's names for these types
            own = F.transform(own, lambda s: s.withField("entity_type", F.when(s["entity_type"] == "PER", "PERSON").otherwise("VEHICLE_MAKE_MODEL")))
        parts.append(own)
    parts.append(detect.regex_candidates("text", profile))
    if llm:
        parts.append(detect.llm_candidates(F.col(llm), F.col("text")))
    if profile == "rules" and dictionaries:
        # A name from a dictionary is a mention like any other: it shares the number of the person it belongs to.
        out = out.withColumn("_linked", F.concat(*[p.cast(detect.NO_SPANS) for p in parts[:2]]))
        parts[:2] = [rules.link_identities(F.col("_linked"))]
    return out.withColumn("candidates", F.concat(*[p.cast(detect.NO_SPANS) for p in parts])).drop("_linked", "rule_spans", "_vehicles", "_names")


def anonymize(documents: DataFrame, dictionaries: bool = True, names=None, vehicles=None, ner: str | None = None, leak_safe: bool = False) -> DataFrame:
    """Profile rules: documents with anonymized_text, replacements, entities_found, total_replacements, review_candidates, whitelist_skipped, warnings.

    A blank text stays as it is, with a warning.
    """
    out = candidates(documents, "rules", dictionaries, names, vehicles, ner)
    out = out.withColumn("_spans", resolve_overlaps(F.col("candidates"), "rules", leak_safe))
    out = out.withColumn("_spans", render.numbered(F.col("_spans")))
    blank = F.trim(F.regexp_replace("text", r"(?U)\s+", "")) == ""
    warnings = F.concat(
        F.when(blank, F.array(F.lit("Получен пустой текст"))).otherwise(F.array().cast("array<string>")),
        F.transform("review_candidates", lambda r: F.concat(F.lit("Требует проверки "), r["entity_type"], F.lit(": '"), r["original"], F.lit("' ("), r["reason"], F.lit(")"))))
    return out.withColumns({
        "anonymized_text": replace_spans(F.col("text"), F.col("_spans"), lambda s: s["placeholder"]),
        "replacements": render.records(F.col("_spans")),
        "entities_found": render.entities_found(F.col("_spans")),
        "total_replacements": F.size("_spans"),
        "warnings": warnings,
    }).drop("_spans", "candidates")


def anonymize_tokens(documents: DataFrame, dictionaries: bool = True, names=None, vehicles=None, llm: str | None = None, counter: str = "type") -> DataFrame:
    """Profile tokens: documents with anonymized_text, spans, mapping (token to original), reverse_mapping, degraded, sources."""
    out = candidates(documents, "tokens", dictionaries, names, vehicles, llm=llm)
    out = out.withColumn("_spans", resolve_overlaps(F.col("candidates"), "tokens"))
    out = out.withColumn("spans", render.tokenized(F.col("_spans"), counter, F.col("text")))
    return out.withColumns({
        "anonymized_text": replace_spans(F.col("text"), F.col("spans"), lambda s: s["token"]),
        "mapping": render.token_map(F.col("spans")),
        "reverse_mapping": F.map_from_entries(F.array_distinct(F.transform("spans", lambda s: F.struct(s["original"], s["token"])))),
        "degraded": detect.llm_degraded(F.col(llm)) if llm else F.lit(False),
        "sources": render.spans_by_source(F.col("spans")),
    }).drop("_spans", "candidates")


def deanonymize(documents: DataFrame, text: str = "anonymized_text", mapping: str = "mapping") -> DataFrame:
    """documents with restored_text."""
    return documents.withColumn("restored_text", render.restore(F.col(text), F.col(mapping)))


def span_id(s):
    """A span's stable name: start:end:source:type."""
    return F.concat_ws(":", s["start"], s["end"], s["source"], s["entity_type"])


def span_table(resolved: DataFrame, columns: Sequence[str] = ("doc_id",), spans: str = "replacements") -> DataFrame:
    """One row a span."""
    return resolved.select(*columns, F.posexplode(spans).alias("n", "_s")).select(*columns, "n", "_s.*")
