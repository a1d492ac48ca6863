"""Streams: anonymising what arrives, appending to the audit log, review sessions with a fixed lifetime."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.functions.spans import replace_spans, resolve_overlaps
from lexweave.operators import detect, render, rules

SESSION_SECONDS = 3600.0


def anonymize_stream(documents: DataFrame) -> DataFrame:
    """A stream of documents (doc_id, text, ...) with anonymized_text and total_replacements.

    Rules and patterns work on one document at a time, so there is no state; dictionaries are joined in foreachBatch if wanted.
    """
    out = rules.refine(documents.withColumn("text", F.coalesce("text", F.lit(""))))
    every = F.concat(F.col("rule_spans").cast(detect.NO_SPANS), detect.regex_candidates("text").cast(detect.NO_SPANS))
    out = out.withColumn("_spans", render.numbered(resolve_overlaps(every)))
    return out.withColumns({"anonymized_text": replace_spans(F.col("text"), F.col("_spans"), lambda s: s["placeholder"]), "total_replacements": F.size("_spans")}).drop(
        "_spans", "rule_spans", "review_candidates", "whitelist_skipped")


def append_audit(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of audit rows to a Parquet table; each batch is written once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _in_order(operations: DataFrame, *more: str) -> DataFrame:
    """The columns of session operations, without a null time."""
    return operations.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("string").alias("op"),
                             F.coalesce(F.col("at").cast("double"), F.lit(0.0)).alias("at"), F.col("data").cast("string").alias("data"), *more)


class _Sessions(StatefulProcessor):
    """A session's data and the moment up to which it lives; a timer takes it away, whether or not it is asked for again."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "data string, expires double")

    @staticmethod
    def _timer(expires: float) -> int:
        return ceil(expires * 1000) + 1

    def _end(self, held: tuple[str | None, float] | None) -> None:
        if held is not None:
            self.handle.deleteTimer(self._timer(held[1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        came = [(None if pd.isna(r.seq) else int(r.seq), r.op, r.at, r.data) for frame in rows for r in frame.itertuples(index=False)]
        came.sort(key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
        before = held = tuple(self.session.get()) if self.session.exists() else None
        out = []
        for seq, op, at, data in came:
            if held is not None and at > held[1]:
                held = None
            if op == "create":
                held = (data, at + self.ttl)
            elif op == "update" and held is not None:
                held = (data, held[1])
            out.append((key[0], seq, op, held is not None, None if held is None or op == "delete" else held[0]))
            held = None if op == "delete" else held
        if held is None or before is None or held[1] != before[1]:
            self._end(before)
            if held is not None:
                self.handle.registerTimer(self._timer(held[1]))
        if held is not None:
            self.session.update(held)
        elif before is not None:
            self.session.clear()
        yield pd.DataFrame(out, columns=_STATES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.session.clear()
        yield pd.DataFrame([], columns=_STATES)

    def close(self) -> None:
        pass


_STATES = ["session_id", "seq", "op", "ok", "data"]


def session_states(operations: DataFrame, ttl: float = SESSION_SECONDS, late: str = "10 minutes") -> DataFrame:
    """What each session operation gives back: (session_id, seq, op, ok, data).

    operations: session_id, seq, op (create, get, update, delete), at (seconds), data; a stream or a table. A session ends
    `ttl` seconds after its creation, at the first moment later than that; updates don't prolong it. Operations of a
    session count by seq, then op, time and data. An operation of another name, or of none, reads; a null time
    is 0; the operations without a session_id are one session's; an empty table gives an empty one.

    In a stream the time is event time: a session is taken from the state once the watermark, `late` behind the latest
    operation, is past its end. Operations from before the watermark are left out, as Spark's watermarks do. Timers need
    the RocksDB state store, which is chosen here. A table is worked on by windows alone: one shuffle by session.
    """
    if operations.isStreaming:
        conf = operations.sparkSession.conf
        conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        timed = _in_order(operations).withColumn("happened", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("happened", late)
        return timed.groupBy("session_id").transformWithStateInPandas(_Sessions(ttl), "session_id string, seq long, op string, ok boolean, data string", "append", "eventTime")
    order = [F.col(c) for c in ("seq", "op", "at", "data")]
    session = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A creation begins anew, so what is known of a session lies between it and the next.
    life = Window.partitionBy("session_id", "life").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = life.rowsBetween(Window.unboundedPreceding, -1)
    is_op = lambda name: F.coalesce(F.col("op") == name, F.lit(False))
    rows = _in_order(operations).withColumn("life", F.sum(is_op("create").cast("long")).over(session))
    lives = (F.col("life") > 0) & ~F.coalesce(F.max(is_op("delete")).over(before), F.lit(False)) & (F.max("at").over(life) <= F.first("at").over(life) + ttl)
    held = F.last(F.when(is_op("create") | is_op("update"), F.struct("data")), ignorenulls=True).over(life)
    known = rows.select("session_id", "seq", "op", lives.alias("ok"), held["data"].alias("data"))
    return known.withColumn("data", F.when(F.col("ok") & ~is_op("delete"), F.col("data")))
