"""Archive of cases and audit log as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LISTED = ("id", "created_at", "filename", "input_type", "status", "total_replacements")
ACTIONS = ("app_shutdown_requested", "case_opened", "export_docx", "export_pdf", "case_reviewed", "case_deleted", "cases_compared", "analysis_completed", "preview_created")


def with_ids(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """rows with id: consecutive numbers above `after`, in the given order.

    Rows are dealt out by ranges of the order and numbered there; the sizes of the ranges, one number a partition, give each range its first number.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    first, starts = after, {}
    for part, n in sizes:
        starts[part] = first
        first += n
    base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")] if starts else F.lit(after)
    return dealt.withColumn("id", (base + F.row_number().over(W.partitionBy("_part").orderBy(*order))).cast("long")).drop("_part")


class Archive:
    """Cases under a folder: cases/ holds them as saved, events/ their later states (reviewed, deleted)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def save(self, cases: DataFrame, order: list[str]) -> None:
        """Appends cases (any columns) with new ids, the time and the status processed."""
        old = self._read("cases")
        last = (old.agg(F.max("id")).first()[0] or 0) if old is not None else 0
        made = with_ids(cases.drop("id", "created_at", "status"), order, last)
        made.withColumns({"created_at": F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz"), "status": F.lit("processed")}).write.mode("append").parquet(f"{self.path}/cases")

    def _event(self, case_id: int, status: str) -> bool:
        if self.case(case_id).isEmpty():
            return False
        self.spark.range(1).select(F.lit(case_id).cast("long").alias("id"), F.lit(status).alias("status"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/events")
        return True

    def mark_reviewed(self, case_id: int) -> bool:
        return self._event(case_id, "reviewed")

    def delete(self, case_id: int) -> bool:
        return self._event(case_id, "deleted")

    def cases(self) -> DataFrame:
        """All cases that aren't deleted, in their current state."""
        cases, events = self._read("cases"), self._read("events")
        if cases is None:
            raise FileNotFoundError(f"no cases under {self.path}")
        return current_cases(cases, events) if events is not None else cases

    def case(self, case_id: int) -> DataFrame:
        return self.cases().where(F.col("id") == case_id)

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return page(self.cases(), LISTED, limit, offset)


def current_cases(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases with the status of their last event; deleted ones are left out."""
    last = events.groupBy("id").agg(F.max(F.struct("at", "status")).alias("e"), F.max((F.col("status") == "deleted").cast("int")).alias("gone"))
    kept = cases.join(last, "id", "left").where(F.coalesce("gone", F.lit(0)) == 0)
    return kept.withColumn("status", F.coalesce("e.status", "status")).select(*cases.columns)


def page(rows: DataFrame, columns, limit: int = 50, offset: int = 0, order: str = "id") -> DataFrame:
    """Newest rows first, without the first `offset`, `limit` at most."""
    return rows.select(*columns).orderBy(F.desc(order)).offset(offset).limit(limit)


def audit_page(entries: DataFrame, limit: int = 100, offset: int = 0, case_id: int | None = None) -> DataFrame:
    """Audit entries, of one case if said so, newest first."""
    some = entries if case_id is None else entries.where(F.col("case_id") == case_id)
    return page(some, entries.columns, limit, offset)


def audit_events(events: DataFrame, actor: Column | None = None, default_actor: str = "local-user") -> DataFrame:
    """events (action, subject, case_id, details) as audit rows: actor and time added, details as JSON."""
    who = F.coalesce(F.nullif(F.trim(actor), F.lit("")) if actor is not None else F.lit(None).cast("string"), F.lit(default_actor))
    details = F.coalesce(F.to_json("details"), F.lit("{}"))
    return events.select(F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz").alias("created_at"), who.alias("actor"), "action", "case_id", F.coalesce("subject", F.lit("")).alias("subject"), details.alias("details"))


def report(case: Column) -> Column:
    """A case as the lines of a report."""
    dash = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    lines = lambda items, a, b, c: F.when(F.size(F.coalesce(items, F.array())) == 0, F.array(F.lit("• Нет данных"))).otherwise(F.transform(
        items, lambda i: F.concat(F.lit("• "), dash(i[a]), F.lit(" | "), dash(i[b]), F.lit(" | "), empty(i[c]))))
    head = F.array(
        F.concat(F.lit("Дело: #"), dash(case["id"])), F.concat(F.lit("Файл: "), F.coalesce(F.nullif(case["filename"], F.lit("")), F.lit("Без имени"))),
        F.concat(F.lit("Дата: "), dash(case["created_at"])), F.concat(F.lit("Источник анализа: "), dash(case["source"])), F.lit(""), F.lit("КРАТКОЕ РЕЗЮМЕ"), dash(case["legal_summary"]), F.lit(""),
        F.lit("РЕКОМЕНДАЦИИ"), dash(case["recommendations"]), F.lit(""), F.lit("НОРМЫ ЗАКОНОДАТЕЛЬСТВА"))
    tail = F.array(F.lit(""), F.lit("АНОНИМИЗИРОВАННЫЙ ТЕКСТ"), dash(case["anonymized_text"]))
    return F.array_join(F.concat(head, lines(case["relevant_laws"], "article", "title", "text"), F.array(F.lit(""), F.lit("СУДЕБНАЯ ПРАКТИКА")), lines(case["court_practice"], "case", "court", "outcome"), tail), "\n")
