"""Rendering resolved spans: numbered placeholders, reversible tokens, review, highlighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.patterns import PLACEHOLDERS, TOKEN_TYPES
from lexweave.functions.spans import find_spans, replace_spans, resolve_overlaps
from lexweave.functions.text import canonical_org, escape_html, placeholder_key

RECORD = "array<struct<original:string,placeholder:string,entity_type:string,start:int,end:int,text_start:int,text_end:int,source:string,confidence:double>>"


def _label(entity_type: Column) -> Column:
    out = entity_type
    for kind, label in PLACEHOLDERS.items():
        out = F.when(entity_type == kind, label).otherwise(out)
    return out


def numbered(spans: Column) -> Column:
    """Spans with placeholder: [TYPE1], [TYPE2]... by type, in order of first appearance; mentions of one entity share a number.

    The entity is the identity key or else the normalised text (of organisations with the legal form in the nominative).
    """
    keyed = F.transform(spans, lambda s: s.withField("key", F.concat_ws("\u0001", s["entity_type"], F.coalesce(
        s["identity_key"], F.when(s["entity_type"] == "ORG", canonical_org(s["original"])).otherwise(placeholder_key(s["original"]))))))
    firsts = F.aggregate(keyed, F.array().cast("array<struct<key:string,entity_type:string>>"), lambda acc, s: F.when(
        F.exists(acc, lambda a: a["key"] == s["key"]), acc).otherwise(F.concat(acc, F.array(F.struct(s["key"].alias("key"), s["entity_type"].alias("entity_type"))))))
    number = lambda s, order: F.array_position(F.transform(F.filter(order, lambda a: a["entity_type"] == s["entity_type"]), lambda a: a["key"]), s["key"])
    return F.element_at(F.transform(F.array(F.struct(firsts.alias("order"), keyed.alias("spans"))), lambda z: F.transform(
        z["spans"], lambda s: s.withField("placeholder", F.concat(F.lit("["), _label(s["entity_type"]), number(s, z["order"]).cast("string"), F.lit("]"))))), 1)


#: What a token looks like.
TOKEN = r"\[[A-Z_]+_\d+\]"


def records(spans: Column) -> Column:
    """One record a replacement; start and end are offsets in the new text, text_start and text_end in the old one."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("moved"), F.array().cast(RECORD).alias("out")),
        lambda acc, s: F.struct(
            (acc["moved"] + F.length(s["placeholder"]) - (s["end"] - s["start"])).alias("moved"),
            F.concat(acc["out"], F.array(F.struct(
                s["original"].alias("original"), s["placeholder"].alias("placeholder"), s["entity_type"].alias("entity_type"),
                (s["start"] + acc["moved"]).alias("start"), (s["start"] + acc["moved"] + F.length(s["placeholder"])).alias("end"),
                s["start"].alias("text_start"), s["end"].alias("text_end"), s["source"].alias("source"), s["confidence"].alias("confidence")))).alias("out")),
        lambda acc: acc["out"],
    )


def entities_found(spans: Column) -> Column:
    """map<type, originals in order of appearance, repeats included>."""
    types = F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))
    return F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.transform(F.filter(spans, lambda s: s["entity_type"] == t), lambda s: s["original"]))))


def _count(spans: Column, source: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["source"] == source))


def spans_by_source(spans: Column, sources: tuple[str, ...] = ("regex", "dict", "llm")) -> Column:
    """How many spans each source has given, as a struct."""
    return F.struct(*[_count(spans, x).alias(x) for x in sources])


def tokenized(spans: Column, counter: str = "type", text: Column | None = None) -> Column:
    """Spans with token, numbered from the right: [TYPE_001] by type, or [TYPE_1] with one counter (counter="all").

    Equal originals share a token; its type is that of the right-most of them. Tokens that `text` itself spells are
    passed over, so that what stands in the new text for an original can't be mistaken.
    """
    spelt = F.array().cast("array<string>") if text is None else F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    firsts = F.aggregate(F.reverse(spans), F.array().cast("array<struct<original:string,entity_type:string>>"), lambda acc, s: F.when(
        F.exists(acc, lambda a: a["original"] == s["original"]), acc).otherwise(F.concat(acc, F.array(F.struct(s["original"].alias("original"), s["entity_type"].alias("entity_type"))))))

    def token(s: Column, order: Column, held: Column) -> Column:
        kind = F.element_at(F.filter(order, lambda a: a["original"] == s["original"]), 1)["entity_type"]
        among = order if counter == "all" else F.filter(order, lambda a: a["entity_type"] == kind)
        n = F.array_position(F.transform(among, lambda a: a["original"]), s["original"]).cast("int")

        def said(x: Column) -> Column:
            x = x.cast("string")
            return F.concat(F.lit("["), kind, F.lit("_"), x if counter == "all" else F.when(F.length(x) < 3, F.lpad(x, 3, "0")).otherwise(x), F.lit("]"))

        free = F.filter(F.sequence(F.lit(1), n + F.size(held)), lambda x: ~F.array_contains(held, said(x)))
        return F.when(F.size(held) == 0, said(n)).otherwise(said(F.element_at(free, n)))

    return F.element_at(F.transform(F.array(F.struct(firsts.alias("order"), spans.alias("spans"), spelt.alias("spelt"))), lambda z: F.transform(
        z["spans"], lambda s: s.withField("token", token(s, z["order"], z["spelt"])))), 1)


def token_map(spans: Column) -> Column:
    """map<token, original> of tokenized spans."""
    return F.map_from_entries(F.array_distinct(F.transform(spans, lambda s: F.struct(s["token"], s["original"]))))


def restore(text: Column, mapping: Column) -> Column:
    """The text with every token of map<token, original> replaced by its original, in one pass: what has been put in is
    not looked at again."""
    originals = F.transform(find_spans(text, TOKEN), lambda s: s.withField("as", F.coalesce(F.try_element_at(mapping, s["original"]), s["original"])))
    return replace_spans(text, originals, lambda s: s["as"])


def approved_text(text: Column, spans: Column, selected: Column, manual_text: Column | None = None, manual_type: Column | None = None) -> Column:
    """The text rebuilt from the selected spans only (selected: array of start:end:source:type), and a piece marked by hand.

    Of the piece marked by hand the first occurrence counts; spans without a token become [TYPE_MANUAL].
    """
    chosen = F.filter(spans, lambda s: F.array_contains(selected, F.concat_ws(":", s["start"], s["end"], s["source"], s["entity_type"])))
    plain = F.transform(chosen, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "entity_type", "original", "source", "confidence", "identity_key")],
                                                   F.lit(0).alias("ordinal")))
    if manual_text is not None and manual_type is not None:
        at = F.call_function("locate", manual_text, text)
        known = manual_type.isin(*TOKEN_TYPES) & (F.coalesce(manual_text, F.lit("")) != "") & (at > 0)
        by_hand = F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(manual_text)).alias("end"), manual_type.alias("entity_type"), manual_text.alias("original"),
                                   F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("identity_key"), F.lit(1).alias("ordinal")))
        plain = F.when(F.coalesce(known, F.lit(False)), F.concat(plain, by_hand)).otherwise(plain)
    tokens = F.map_from_entries(F.array_distinct(F.transform(spans, lambda s: F.struct(s["original"], s["token"]))))
    kept = resolve_overlaps(plain, "tokens")
    return replace_spans(text, kept, lambda s: F.coalesce(F.try_element_at(tokens, s["original"]), F.concat(F.lit("["), s["entity_type"], F.lit("_MANUAL]"))))


def highlight_spans(text: Column, spans: Column, css_class: str = "pdn") -> Column:
    """The text as HTML, escaped, each span in a mark element titled by its type; spans outside the text are left out."""
    inside = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"]))
    walk = F.aggregate(inside, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(
            acc["out"], escape_html(F.substring(text, acc["at"] + 1, s["start"] - acc["at"])), F.lit(f'<mark class="{css_class}" title="'), escape_html(s["entity_type"]), F.lit('">'),
            escape_html(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>")).alias("out")))
    return F.element_at(F.transform(F.array(walk), lambda w: F.concat(w["out"], escape_html(F.substring(text, w["at"] + 1, F.length(text))))), 1)


def highlight_tokens(text: Column) -> Column:
    """The text as HTML, escaped, each token in a mark element."""
    return F.regexp_replace(escape_html(text), r"(\[[A-Z_]+_\d+\])", '<mark class="token">$1</mark>')


def redact_contacts(text: Column, pattern: str, label: str) -> Column:
    """The text with every match replaced by one label, without numbers."""
    return replace_spans(text, find_spans(text, pattern), lambda s: F.lit(label))


def json_response(anonymized: DataFrame, columns: Sequence[str] = ("anonymized_text", "entities_found", "total_replacements", "replacements", "warnings", "review_candidates", "whitelist_skipped")) -> DataFrame:
    """anonymize()'s rows with one more column, response: what a caller gets, as JSON; nulls are written as null."""
    return anonymized.withColumn("response", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
