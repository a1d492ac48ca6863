"""Anonymising the documents of cases as they arrive: all documents of a case share the numbers of its entities.

Detection and rules work on one document at a time, dictionaries included. Numbers belong to a case: an entity has that of its first
mention, by the documents' order in the case and the place in the document. In a stream they are keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.functions.spans import replace_spans, resolve_overlaps
from lexweave.functions.text import canonical_org, placeholder_key
from lexweave.operators import anonymize, render
from lexweave.session import settle

_SPANS = "array<struct<start:int,end:int,entity_type:string,original:string,key:string>>"


def _keyed(documents: DataFrame, **options) -> DataFrame:
    """documents with `spans`: what is resolved, each with the key of its entity."""
    found = anonymize.candidates(documents, "rules", **options)
    key = lambda s: F.coalesce(s["identity_key"], F.when(s["entity_type"] == "ORG", canonical_org(s["original"])).otherwise(placeholder_key(s["original"])))
    spans = F.transform(resolve_overlaps(F.col("candidates")), lambda s: F.struct(s["start"], s["end"], s["entity_type"], s["original"], F.concat_ws("\u0001", s["entity_type"], key(s)).alias("key")))
    return found.withColumn("spans", spans.cast(_SPANS)).drop("candidates", "review_candidates", "whitelist_skipped")


def _placeholder(entity_type: Column, number: Column) -> Column:
    return F.concat(F.lit("["), render._label(entity_type), number.cast("string"), F.lit("]"))


class _Numbers(StatefulProcessor):
    """The numbers of a case's entities, and the last number of each type."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "key string", "number int")
        self.last = handle.getMapState("last", "entity_type string", "number int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        came = pd.concat(list(rows)).sort_values(["seq", "doc"], na_position="first", kind="stable")
        out = []
        for r in came.itertuples(index=False):
            numbers = []
            for kind, entity in zip(r.types, r.keys):
                if not self.numbers.containsKey((entity,)):
                    number = (self.last.getValue((kind,))[0] if self.last.containsKey((kind,)) else 0) + 1
                    self.last.updateValue((kind,), (number,))
                    self.numbers.updateValue((entity,), (number,))
                numbers.append(int(self.numbers.getValue((entity,))[0]))
            out.append((key[0], r.seq, r.doc, r.text, r.spans, numbers))
        yield pd.DataFrame(out, columns=["case_id", "seq", "doc_id", "text", "spans", "numbers"])

    def close(self) -> None:
        pass


def _render(documents: DataFrame) -> DataFrame:
    """case_id, seq, doc_id, anonymized_text, total_replacements, from spans and their placeholders."""
    placed = F.transform(F.arrays_zip(F.col("spans").alias("span"), F.col("placeholders").alias("placeholder")), lambda z: F.struct(
        z["span"]["start"].alias("start"), z["span"]["end"].alias("end"), z["placeholder"].alias("placeholder")))
    ready = documents.withColumn("placed", placed)
    return ready.select("case_id", "seq", "doc_id", replace_spans(F.col("text"), F.col("placed"), lambda s: s["placeholder"]).alias("anonymized_text"), F.size("placed").alias("total_replacements"))


def anonymize_cases(documents: DataFrame, **options) -> DataFrame:
    """case_id, seq, doc_id, anonymized_text, total_replacements of documents (case_id, seq, doc_id, text), a stream or a table.

    seq orders the documents of a case, then doc_id does; in a stream a case's documents must arrive in that order, those of
    one micro-batch in any. Null texts are empty, null cases are one case, null seqs come first; rows of equal seq and id
    are documents of their own, other columns are left out; an empty table gives an empty one. options are those of
    anonymize.candidates. The state of a stream has a number for each entity of each case; it needs the RocksDB store, which is chosen here.
    """
    found = _keyed(documents.select(F.col("case_id").cast("string").alias("case_id"), F.col("seq").cast("long").alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    if documents.isStreaming:
        documents.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        rows = found.select("case_id", "seq", F.col("doc_id").alias("doc"), "text", F.to_json("spans").alias("spans"), F.transform("spans", lambda s: s["entity_type"]).alias("types"), F.transform("spans", lambda s: s["key"]).alias("keys"))
        numbered = rows.groupBy("case_id").transformWithStateInPandas(
            _Numbers(), "case_id string, seq long, doc_id long, text string, spans string, numbers array<int>", "append", "none")
        spans = numbered.withColumn("spans", F.from_json("spans", _SPANS))
        return _render(spans.withColumn("placeholders", F.transform(F.arrays_zip(F.col("spans").alias("s"), F.col("numbers").alias("n")), lambda z: _placeholder(z["s"]["entity_type"], z["n"]))))
    rows = settle(found.withColumn("row", F.monotonically_increasing_id()))
    mentions = rows.select("row", "case_id", "seq", "doc_id", F.inline("spans"))
    # Of an entity's mentions one leaves each task.
    first = mentions.groupBy("case_id", "entity_type", "key").agg(F.min(F.struct(F.col("seq").isNotNull().alias("known"), "seq", F.col("doc_id").isNotNull().alias("named"), "doc_id", "row", "start")).alias("first"))
    number = F.row_number().over(Window.partitionBy("case_id", "entity_type").orderBy("first"))
    numbers = settle(first.select("case_id", "key", _placeholder(F.col("entity_type"), number).alias("placeholder")))
    own = mentions.select("row", F.coalesce("case_id", F.lit("")).alias("case"), F.col("case_id").isNull().alias("none"), "key").distinct().join(
        numbers.select(F.coalesce("case_id", F.lit("")).alias("case"), F.col("case_id").isNull().alias("none"), "key", "placeholder"), ["case", "none", "key"])
    maps = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "placeholder"))).alias("of"))  # a document's own entities
    return _render(rows.join(maps, "row", "left").withColumn("placeholders", F.transform("spans", lambda s: F.element_at("of", s["key"]))))
