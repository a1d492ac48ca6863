"""Queries of the library's own operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.patterns import RULES_PATTERNS
from lexweave.functions.spans import find_spans, resolve_overlaps
from lexweave.operators import anonymize, classify, compare, detect, evaluate, render, rules
from lexweave.session import spread, table
from lexweave.sources import documents as docs_source
from lexweave.sources import store
from lexweave.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_EMAIL, _CARD, _PHONE = (next(s.pattern for s in RULES_PATTERNS if s.entity_type == t) for t in ("EMAIL", "БАНК_КАРТА", "ТЕЛЕФОН"))
# The same in SQL: (?U) is the default there for what these patterns meet.
_SQL_EMAIL, _SQL_CARD, _SQL_PHONE = (p.removeprefix("(?U)") for p in (_EMAIL, _CARD, _PHONE))


def query(sql: str | None = None):
    """Registers a query, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def anonymize_documents(spark, sf_dir):
    """The flagship: all detectors, resolution and rendering over every document."""
    out = anonymize.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("total_replacements").cast("long").alias("total_replacements"), F.sha2("anonymized_text", 256).alias("anonymized_sha256"), "anonymized_text")


def _counts(name: str, pattern: str, sql_pattern: str) -> None:
    def f(spark, sf_dir):
        documents = table(spark, sf_dir, "documents").select("doc_id", F.size(find_spans("text", pattern)).cast("long").alias("hits"))
        return documents.where("hits > 0")

    f.__name__ = name
    query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{sql_pattern}')) AS BIGINT) AS hits FROM documents WHERE len(regexp_extract_all(text, '{sql_pattern}')) > 0")(f)


_counts("detect_email", _EMAIL, _SQL_EMAIL)
_counts("detect_card", _CARD, _SQL_CARD)
_counts("detect_phone", _PHONE, _SQL_PHONE)


@query(f"""WITH p AS (SELECT page_id, html FROM pages)
SELECT page_id, kind, CAST(len(hits) AS BIGINT) AS hits FROM (
  SELECT page_id, 'EMAIL' AS kind, regexp_extract_all(html, '{_SQL_EMAIL}') AS hits FROM p UNION ALL
  SELECT page_id, 'CARD', regexp_extract_all(html, '{_SQL_CARD}') FROM p UNION ALL
  SELECT page_id, 'PHONE', regexp_extract_all(html, '{_SQL_PHONE}') FROM p) WHERE len(hits) > 0""")
def detect_in_pages(spark, sf_dir):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(find_spans(F.col("html"), p)).cast("long").alias("hits")) for k, p in (("EMAIL", _EMAIL), ("CARD", _CARD), ("PHONE", _PHONE))])
    return table(spark, sf_dir, "pages").select("page_id", F.explode(kinds).alias("k")).select("page_id", "k.kind", "k.hits").where("hits > 0")


def _sql_spans(kind: str, pattern: str, ordinal: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS entity_type, {ordinal} AS ord, original,
      CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + sum(length(original)) OVER (PARTITION BY doc_id ORDER BY i) - length(original) AS BIGINT) AS start_at
    FROM (SELECT doc_id, unnest(hits) AS original, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM documents) WHERE len(hits) > 0)"""


_SQL_ALL_SPANS = f"{_sql_spans('БАНК_КАРТА', _SQL_CARD, 1)} UNION ALL {_sql_spans('ТЕЛЕФОН', _SQL_PHONE, 14)} UNION ALL {_sql_spans('EMAIL', _SQL_EMAIL, 15)}"


@query(f"SELECT doc_id, entity_type, original, start_at, CAST(start_at + length(original) AS BIGINT) AS end_at FROM ({_SQL_ALL_SPANS})")
def detect_spans_offsets(spark, sf_dir):
    specs = [s for s in RULES_PATTERNS if s.entity_type in ("EMAIL", "БАНК_КАРТА", "ТЕЛЕФОН")]
    return _spans(table(spark, sf_dir, "documents"), detect.regex_candidates("text", specs=specs))


def _spans(documents: DataFrame, spans) -> DataFrame:
    rows = documents.select("doc_id", F.explode(spans).alias("s"))
    return rows.select("doc_id", "s.entity_type", "s.original", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


# Of spans that overlap the longer wins; here cards are the longest and phones stand inside them or alone.
@query(f"""WITH s AS (SELECT *, start_at + length(original) AS end_at FROM ({_SQL_ALL_SPANS}))
SELECT doc_id, entity_type, original, start_at, CAST(end_at AS BIGINT) AS end_at FROM s WHERE NOT EXISTS (
  SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start_at < s.end_at AND o.end_at > s.start_at
    AND (length(o.original) > length(s.original) OR (length(o.original) = length(s.original) AND o.ord < s.ord)))""")
def resolve_overlapping_spans(spark, sf_dir):
    specs = [s for s in RULES_PATTERNS if s.entity_type in ("EMAIL", "БАНК_КАРТА", "ТЕЛЕФОН")]
    return _spans(table(spark, sf_dir, "documents"), resolve_overlaps(detect.regex_candidates("text", specs=specs)))


@query(f"""SELECT entity_type, CAST(count(*) AS BIGINT) AS mentions, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(DISTINCT original) AS BIGINT) AS originals
FROM ({_SQL_ALL_SPANS}) GROUP BY entity_type""")
def entities_by_type(spark, sf_dir):
    return detect_spans_offsets(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.countDistinct("original").alias("originals"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_SQL_CARD}')) + len(regexp_extract_all(text, '{_SQL_EMAIL}')) AS BIGINT) AS regex, CAST(0 AS BIGINT) AS dict, CAST(0 AS BIGINT) AS llm FROM documents")
def spans_by_source(spark, sf_dir):
    specs = [s for s in RULES_PATTERNS if s.entity_type in ("EMAIL", "БАНК_КАРТА")]
    found = table(spark, sf_dir, "documents").select("doc_id", detect.regex_candidates("text", specs=specs).alias("s"))
    counts = found.select("doc_id", render.spans_by_source(F.col("s")).alias("n"))
    return counts.select("doc_id", *[F.col(f"n.{c}").cast("long").alias(c) for c in ("regex", "dict", "llm")])


@query("SELECT doc_id, true AS restored FROM documents")
def deanonymize_roundtrip(spark, sf_dir):
    out = anonymize.deanonymize(anonymize.anonymize_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), dictionaries=False))
    return out.select("doc_id", (F.col("restored_text") == F.col("text")).alias("restored"))


_SQL_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\x0b\x0c]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\x{FEFF}+', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"""


@query(f"SELECT doc_id, sha256({_SQL_NORMAL}) AS normal_sha256, CAST(length({_SQL_NORMAL}) AS BIGINT) AS normal_chars FROM documents")
def text_normalize(spark, sf_dir):
    normal = tx.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", normal.alias("t")).select("doc_id", F.sha2("t", 256).alias("normal_sha256"), F.length("t").cast("long").alias("normal_chars"))


_SQL_STRIPPED = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH d AS (SELECT doc_id, {_SQL_STRIPPED} AS t FROM documents)
SELECT doc_id, CASE WHEN t <> '' THEN CAST(len(regexp_extract_all(t, '\\p{{L}}')) * 2 + len(regexp_extract_all(t, '\\p{{Nd}}')) + least(length(t) - length(replace(t, ' ', '')), 120)
  - 6 * (length(t) - length(replace(t, '?', '')) + 8 * (length(t) - length(replace(t, chr(65533), ''))))
  - 30 * len(regexp_extract_all(t, '(?:(?:^|[^\\pL\\pN_])[А-Яа-яA-Za-zЁё](?:\\s+|$)){{1}}(?:[А-Яа-яA-Za-zЁё](?:\\s+|$)){{4,}}')) AS DOUBLE) END AS score FROM d""")
def text_quality_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.quality_score(F.col("text")).alias("score"))


@query(f"""WITH d AS (SELECT doc_id, {_SQL_STRIPPED} AS t FROM documents)
SELECT doc_id, t <> '' AND ((length(t) - length(replace(t, '?', ''))) / greatest(length(t), 1) > 0.12 OR (length(t) - length(replace(t, chr(65533), ''))) / greatest(length(t), 1) > 0.02
  OR regexp_matches(t, '(?:^|[^\\pL\\pN_])[А-Яа-яA-Za-zЁё]\\s+(?:[А-Яа-яA-Za-zЁё](?:\\s+|$)){{4,}}')) AS corrupted FROM d""")
def looks_corrupted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.looks_corrupted(F.col("text")).alias("corrupted"))


@query(f"SELECT coalesce(error, 'none') AS error, CAST(count(*) AS BIGINT) AS documents FROM (SELECT CASE WHEN {_SQL_STRIPPED} = '' THEN 'empty' WHEN length({_SQL_NORMAL}) > 500000 THEN 'too_long' WHEN length({_SQL_NORMAL}) < 20 THEN 'too_short' END AS error FROM documents) GROUP BY 1")
def typed_text_gate(spark, sf_dir):
    errors = table(spark, sf_dir, "documents").select(F.coalesce(tx.typed_text_error(F.col("text")), F.lit("none")).alias("error"))
    return errors.groupBy("error").agg(F.count("*").alias("documents"))


# The better of a text and the same text spoilt: question marks for vowels.
@query("SELECT doc_id, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS best_sha256 FROM documents WHERE regexp_matches(text, '[aeiou]')")
def best_candidate(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").where(F.col("text").rlike("[aeiou]"))
    best = tx.best_text(F.array(F.regexp_replace("text", "[aeiou]", "?"), F.col("text"), F.col("text")))
    return documents.select("doc_id", F.sha2(tx.strip(best), 256).alias("best_sha256"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9\-_.]', '_', 'g'), '._'), ''), 'report') AS filename FROM pages""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_filename(F.col("url")).alias("filename"))


@query(r"""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '"', '&#34;')) AS escaped_sha256 FROM pages""")
def escape_pages(spark, sf_dir):
    """Highlighting without spans: the whole text escaped."""
    none = F.array().cast(detect.NO_SPANS)
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(render.highlight_spans(F.col("html"), none), 256).alias("escaped_sha256"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\\[^{}]*\}', ' ', 'g'), '\\[a-zA-Z]+\d* ?', ' ', 'g'), '[{}]', ' ', 'g'), '[ \t\n\r\x0b\x0c]+', ' ', 'g')) AS plain_sha256 FROM documents""")
def rtf_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.rtf_to_text(F.col("text")), 256).alias("plain_sha256"))


@query("SELECT doc_id, sha256(replace(text, chr(13), '')) AS text_sha256, true AS same FROM documents WHERE text IS NOT NULL")
def rtf_round_trip(spark, sf_dir):
    """Documents written as RTF files, with bytes of a code page, Unicode escapes and destinations without text, and read back."""
    code = F.ascii
    one = lambda c: (
        F.when(c == "\n", "\\par\r\n").when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).when(code(c) < 128, c)
        .when((code(c) >= 0xA0) & (code(c) < 0x100), F.concat(F.lit("\\'"), F.lower(F.hex(code(c)))))
        .when(code(c) < 0x10000, F.concat(F.lit("\\u"), F.when(code(c) > 32767, code(c) - 65536).otherwise(code(c)), F.lit("?")))
        .otherwise(F.concat(F.lit("\\u"), F.shiftright(code(c) - 0x10000, 10) + 0xD800 - 65536, F.lit("?\\u"), (code(c) - 0x10000).bitwiseAND(F.lit(1023)) + 0xDC00 - 65536, F.lit("?"))))
    body = F.array_join(F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), ""), one), "")
    head = "{\\rtf1\\ansi\\ansicpg1252\\uc1{\\fonttbl{\\f0\\fcharset0 A;}{\\f1\\fcharset204 {\\*\\falt B}C;}}{\\*\\generator {x}y;}{\\info{\\title z}}\\f0 "
    files = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.encode(F.concat(F.lit(head), body, F.lit("}")), "utf-8").alias("content"))
    read = files.select("doc_id", "text", docs_source.rtf_content("content").alias("read"))
    return read.select("doc_id", F.sha2("read", 256).alias("text_sha256"), (F.col("read") == F.replace("text", F.lit("\r"), F.lit(""))).alias("same"))


_TOPIC_ROWS = ("Спор об увольнении работника", "Договор поставки товара", "Налоговая проверка и НДС", "Иной документ", "")


@query("""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'Спор об увольнении работника' UNION ALL SELECT -2, 'Договор поставки товара' UNION ALL SELECT -3, 'Налоговая проверка и НДС'
  UNION ALL SELECT -4, 'Иной документ' UNION ALL SELECT -5, ''),
c AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'труд|увольнен|работник|зарплат') THEN 'labor' WHEN regexp_matches(lower(text), 'договор|сделк|поставк|аренд') THEN 'civil'
  WHEN regexp_matches(lower(text), 'налог|ндс|прибыл|ифнс') THEN 'tax' ELSE 'general' END AS topic FROM t)
SELECT doc_id, topic, CAST(CASE topic WHEN 'general' THEN 1 ELSE 2 END AS BIGINT) AS laws, CAST(1 AS BIGINT) AS practice FROM c""")
def topic_classify(spark, sf_dir):
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_TOPIC_ROWS)], "doc_id long, text string")
    out = classify.analyze(table(spark, sf_dir, "documents").select("doc_id", "text").union(more), "text")
    return out.select("doc_id", "topic", F.size("relevant_laws").cast("long").alias("laws"), F.size("court_practice").cast("long").alias("practice"))


@query("SELECT c_mktsegment AS term, CAST(count(*) AS BIGINT) AS customers FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery') GROUP BY 1")
def whitelist_anti_join(spark, sf_dir):
    """Whitelisted terms leave by equality of their normal keys, never by parts."""
    listed = spark.createDataFrame([("Building ",), ("MACHINERY",)], "term string").select(tx.normal_key(F.col("term")).alias("key"))
    customers = table(spark, sf_dir, "customer").withColumn("key", tx.normal_key(F.col("c_mktsegment")))
    return customers.join(F.broadcast(listed), "key", "left_anti").groupBy(F.col("c_mktsegment").alias("term")).agg(F.count("*").alias("customers"))


# Laws of an order are its parts; those of one order that the next one of the customer hasn't.
@query("""WITH o AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders),
l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
d AS (SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM o JOIN l ON l_orderkey = o_orderkey
  WHERE next_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l r WHERE r.l_orderkey = next_key AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey))
SELECT o_orderkey, CAST(count(*) AS BIGINT) AS only_left, CAST(sum(l_partkey) AS BIGINT) AS parts FROM d WHERE rn <= 10 GROUP BY o_orderkey""")
def items_only_left(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(order).alias("next_key")).where("next_key is not null")
    both = pairs.join(items.select(F.col("l_orderkey").alias("o_orderkey"), F.col("items").alias("left")), "o_orderkey").join(
        items.select(F.col("l_orderkey").alias("next_key"), F.col("items").alias("right")), "next_key", "left")
    kept = both.select("o_orderkey", compare.only_left(F.col("left"), F.coalesce("right", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint>>")), ("l_partkey", "l_suppkey")).alias("d")).where(F.size("d") > 0)
    return kept.select("o_orderkey", F.size("d").cast("long").alias("only_left"), F.aggregate("d", F.lit(0).cast("long"), lambda acc, x: acc + x["l_partkey"]).alias("parts"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderpriority AS filename, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100")
def archive_page(spark, sf_dir):
    """A page of the archive, newest first; orders stand in for cases."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("filename"), F.col("o_orderstatus").alias("status"))
    return store.page(cases, cases.columns, 50, 100)


@query("SELECT event_id AS id, ts AS created_at, event_type AS action, user_id AS case_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 100")
def audit_of_case(spark, sf_dir):
    """The audit log of one case, newest first; events stand in for entries."""
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action"), F.col("user_id").alias("case_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return store.audit_page(entries, 100, 0, 8)


@query("""WITH e AS (SELECT o_orderkey, max(l_shipdate) AS last_ship, bool_or(l_returnflag = 'R') AS gone FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o.o_orderkey AS id, CASE WHEN e.o_orderkey IS NULL THEN o_orderstatus ELSE 'reviewed' END AS status FROM orders o LEFT JOIN e ON e.o_orderkey = o.o_orderkey WHERE NOT coalesce(gone, false)""")
def current_case_states(spark, sf_dir):
    """Cases with the state of their last event; a returned item deletes its order, any other reviews it."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") == "R", "deleted").otherwise("reviewed").alias("status"))
    return store.current_cases(cases, events)


@query("SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) + 1000 AS BIGINT) AS id, c_custkey FROM customer")
def consecutive_ids(spark, sf_dir):
    """Ids for a batch of rows, in an order, without one task holding them all."""
    return store.with_ids(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 1000).select("id", "c_custkey")


@query("""SELECT o_orderkey AS id, sha256(concat('Дело: #', o_orderkey, chr(10), 'Файл: ', o_orderpriority, chr(10), 'Дата: ', '—', chr(10), 'Источник анализа: ', o_orderstatus, chr(10), chr(10), 'КРАТКОЕ РЕЗЮМЕ', chr(10), '—', chr(10), chr(10),
  'РЕКОМЕНДАЦИИ', chr(10), '—', chr(10), chr(10), 'НОРМЫ ЗАКОНОДАТЕЛЬСТВА', chr(10), '• ', 'ст. ', o_custkey, ' | ', 'Закон', ' | ', chr(10), chr(10), 'СУДЕБНАЯ ПРАКТИКА', chr(10), '• Нет данных', chr(10), chr(10), 'АНОНИМИЗИРОВАННЫЙ ТЕКСТ', chr(10), 'текст ', o_orderkey)) AS report_sha256 FROM orders""")
def case_reports(spark, sf_dir):
    law = F.array(F.struct(F.lit("Закон").alias("title"), F.concat(F.lit("ст. "), F.col("o_custkey")).alias("article"), F.lit(None).cast("string").alias("text")))
    case = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"), F.lit(None).cast("string").alias("created_at"), F.col("o_orderstatus").alias("source"), F.lit("").alias("legal_summary"),
        F.lit(None).cast("string").alias("recommendations"), law.alias("relevant_laws"), F.array().cast(f"array<{classify.PRACTICE}>").alias("court_practice"), F.concat(F.lit("текст "), F.col("o_orderkey")).alias("anonymized_text"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(store.report(case), 256).alias("report_sha256"))


# Rows of equal name, brand and type are one span; the dearest of the largest is kept.
@query("""SELECT p_name, p_brand, p_type, CAST(p_partkey AS BIGINT) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def dedupe_best(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand", "p_type").agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey"))).alias("kept"))


@query("""SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(f) AS BIGINT) AS found, CAST(sum(b) AS BIGINT) AS correct, sum(b) / nullif(sum(f), 0) AS "precision", sum(b) / nullif(sum(e), 0) AS recall FROM (
  SELECT c_nationkey, c_mktsegment, max((c_acctbal > 0)::INT) AS e, max((c_acctbal < 5000)::INT) AS f, max((c_acctbal > 0)::INT) * max((c_acctbal < 5000)::INT) AS b FROM customer GROUP BY ALL) GROUP BY 1""")
def corpus_precision_recall(spark, sf_dir):
    """Expected and found sets of segments of each nation, as the corpus metrics compare sets of entities."""
    some = lambda c: F.collect_set(F.when(c, F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(some(F.col("c_acctbal") > 0).alias("e"), some(F.col("c_acctbal") < 5000).alias("f"))
    maps = rows.select(F.col("c_nationkey").cast("long").alias("nation"), F.create_map(F.lit("PER"), F.col("e")).alias("expected"), F.create_map(F.lit("PER"), F.col("f")).alias("entities_found"))
    return evaluate.precision_recall(maps, types=("PER",), by=("nation",)).drop("entity_type")


# Expected: the spans themselves; found: most of them, moved and cut by the document's number.
_SQL_MOVED = f"""SELECT lang, doc_id, entity_type, start_at + doc_id % 4 - 1 AS s, start_at + length(original) - doc_id % 3 AS t FROM ({_SQL_ALL_SPANS}) JOIN documents USING (doc_id) WHERE start_at % 5 > 0"""


@query(f"""WITH e AS (SELECT DISTINCT lang, doc_id, entity_type, start_at AS s, start_at + length(original) AS t FROM ({_SQL_ALL_SPANS}) JOIN documents USING (doc_id)), f AS (SELECT DISTINCT * FROM ({_SQL_MOVED})),
p AS (SELECT e.lang, e.doc_id, e.entity_type, e.s AS es, e.t AS et, f.s AS fs, f.t AS ft, least(e.t, f.t) - greatest(e.s, f.s) AS shared FROM e JOIN f ON e.lang = f.lang AND e.doc_id = f.doc_id AND e.entity_type = f.entity_type AND e.s < f.t AND f.s < e.t),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, es, et ORDER BY shared DESC, fs, ft) AS a, row_number() OVER (PARTITION BY doc_id, entity_type, fs, ft ORDER BY shared DESC, es, et) AS z FROM p),
u AS (SELECT lang, entity_type, 1 AS e, 0 AS f, 0 AS c FROM e UNION ALL SELECT lang, entity_type, 0, 1, 0 FROM f UNION ALL SELECT lang, entity_type, 0, 0, 1 FROM b WHERE a = 1 AND z = 1)
SELECT lang, entity_type, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(f) AS BIGINT) AS found, CAST(sum(c) AS BIGINT) AS correct, sum(c) / nullif(sum(f), 0) AS "precision", sum(c) / nullif(sum(e), 0) AS recall FROM u GROUP BY lang, entity_type""")
def span_metrics_by_language(spark, sf_dir):
    """Precision and recall of spans matched one to one, by language and type."""
    specs = [s for s in RULES_PATTERNS if s.entity_type in ("EMAIL", "БАНК_КАРТА", "ТЕЛЕФОН")]
    spans = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(detect.regex_candidates("text", specs=specs)).alias("s")).select(
        "lang", "doc_id", "s.entity_type", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    moved = spans.where("start % 5 > 0").withColumns({"start": F.col("start") + F.col("doc_id") % 4 - 1, "end": F.col("end") - F.col("doc_id") % 3})
    return evaluate.span_precision_recall(spans, moved, ("lang", "doc_id", "entity_type"), ("lang", "entity_type"))


_JSON_LAWS = '{"documents": [{"title": "%s", "section": "%d", "text": "x"}, {"name": "B", "article": "7", "snippet": "s", "text": "t"}], "result": {"laws": [{"title": "C", "description": "%s"}]}}'


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(3 AS BIGINT) AS laws, n_name AS first_title, CAST(n_regionkey AS VARCHAR) AS first_article, 's' AS second_text, CAST(300 AS BIGINT) AS third_chars,
  'Найдено 3 релевантных нормативных акта(ов). Основные: ' || n_name || ', B, C. Судебная практика: 0 дел(а).' AS summary FROM nation""")
def search_reply_laws(spark, sf_dir):
    reply = F.format_string(_JSON_LAWS, "n_name", "n_regionkey", F.repeat(F.lit("я"), 400))
    laws = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), classify.normalize_laws(reply).alias("l"), classify.normalize_practice(reply).alias("p"))
    item = lambda i, f: F.element_at("l", i)[f]
    return laws.select("id", F.size("l").cast("long").alias("laws"), item(1, "title").alias("first_title"), item(1, "article").alias("first_article"), item(2, "text").alias("second_text"),
                       F.length(item(3, "text")).cast("long").alias("third_chars"), classify.search_summary(F.col("l"), F.col("p")).alias("summary"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS summary, 'Дело ' || n_regionkey || chr(10) || chr(10) || 'РИСКИ: нет' AS recommendations, true AS parsed FROM nation""")
def llm_reply_analysis(spark, sf_dir):
    reply = F.format_string('Ответ:\n```json\n{"summary": "%s", "recommendations": "Дело %d", "risks": " нет "}\n```', "n_name", "n_regionkey")
    parsed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), classify.parse_llm_analysis(reply).alias("a"))
    return parsed.select("id", "a.summary", "a.recommendations", "a.parsed")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(5 AS BIGINT) AS start_at, CAST(5 + length(n_name) AS BIGINT) AS end_at, 'PERSON' AS entity_type, n_name AS original FROM nation""")
def llm_reply_spans(spark, sf_dir):
    """Of three spans in each reply one has an unknown type and one has offsets that don't hold its text."""
    text = F.concat(F.lit("это: "), F.col("n_name"))
    reply = F.format_string('[{"type": "PERSON", "text": "%1$s", "start": 5, "end": %2$d}, {"type": "NOPE", "text": "это", "start": 0, "end": 3}, {"type": "DATE", "text": "%1$s", "start": 0, "end": 3}]', F.col("n_name"), F.length("n_name") + 5)
    found = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.explode(detect.llm_candidates(reply, text)).alias("s"))
    return found.select("id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), "s.entity_type", "s.original")


@query("""SELECT o_orderkey AS id, title FROM orders, (VALUES ('Ст. 1079 ГК РФ'), ('Ст. 12.24 КоАП РФ'), ('Ст. 264 УК РФ'), ('40-ФЗ «Об ОСАГО»'), ('Постановление Пленума ВС РФ № 25')) v(title)""")
def constant_search(spark, sf_dir):
    return classify.road_laws(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "title")


_CASE_LAWS = "list_transform(range(3), lambda k: {'title': 'Закон ' || CAST((doc_id + k) % 5 AS VARCHAR), 'article': source})"


def _document_cases(spark, sf_dir) -> DataFrame:
    """Documents as cases: three laws by number and source, one judgement by language and source."""
    law = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.concat(F.lit("Закон "), ((F.col("doc_id") + k) % 5).cast("string")).alias("title"), F.col("source").alias("article"), F.lit("").alias("text")))
    practice = F.array(F.struct(F.col("lang").alias("case"), F.col("source").alias("court"), F.lit("").alias("outcome")))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", law.alias("laws"), practice.alias("practice"))
    return documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), F.lit(None).cast("string").alias("created_at"), F.lit("processed").alias("status"),
        F.lit("demo").alias("source"), F.lit("").alias("anonymized_text"), F.col("text").alias("original_text"), F.col("lang").alias("legal_summary"), F.col("source").alias("recommendations"),
        F.col("laws").alias("relevant_laws"), F.col("practice").alias("court_practice"))


def _neighbours(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"))


@query(f"""WITH c AS (SELECT doc_id, text, lang, source, {_CASE_LAWS} AS laws FROM documents),
p AS (SELECT l.doc_id AS left_id, r.doc_id AS right_id, l.text AS lt, r.text AS rt, l.lang AS ll, r.lang AS rl, l.source AS ls, r.source AS rs,
  list_filter(l.laws, lambda x: NOT list_contains(r.laws, x)) AS ol, list_filter(r.laws, lambda x: NOT list_contains(l.laws, x)) AS orr FROM c l JOIN c r ON r.doc_id = l.doc_id + 1)
SELECT left_id, right_id, 'doc' || left_id AS left_file, 'doc' || right_id AS right_file, CAST(length(lt) AS BIGINT) AS left_length, CAST(length(rt) AS BIGINT) AS right_length,
  coalesce(array_to_string(list_transform(ol, lambda x: x.title || '/' || x.article), ';'), '') AS laws_only_left, coalesce(array_to_string(list_transform(orr, lambda x: x.title || '/' || x.article), ';'), '') AS laws_only_right,
  CAST((ll <> rl OR ls <> rs)::INT AS BIGINT) AS practice_only_left, CAST((ll <> rl OR ls <> rs)::INT AS BIGINT) AS practice_only_right FROM p""")
def compare_cases_items(spark, sf_dir):
    """Each document with the next as two cases: who they are, how long, which laws and judgements only one of them has."""
    both = compare.compare_cases(_neighbours(spark, sf_dir), _document_cases(spark, sf_dir))
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["title"], x["article"])), ";").alias(c)
    return both.select("left_id", "right_id", F.col("left_case.filename").alias("left_file"), F.col("right_case.filename").alias("right_file"), F.col("left_length").cast("long").alias("left_length"),
                       F.col("right_length").cast("long").alias("right_length"), named("laws_only_left"), named("laws_only_right"),
                       F.size("practice_only_left").cast("long").alias("practice_only_left"), F.size("practice_only_right").cast("long").alias("practice_only_right"))


@query()
def compare_cases_texts(spark, sf_dir):
    """Each document with the next as two cases: how alike they are, and which lines differ; tests hold it against another way."""
    both = compare.compare_cases(_neighbours(spark, sf_dir), _document_cases(spark, sf_dir))
    return both.select("left_id", "right_id", "similarity", "summary_similarity", "recommendations_similarity", F.to_json("highlights").alias("highlights"))


@query()
def turn_similarity(spark, sf_dir):
    """The similarity and differing lines of each turn and the next of its conversation."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.lead("text").over(order).alias("following")).where("following is not null")
    return turns.select("conv_id", "turn", compare.similarity("text", "following").alias("similarity"), F.size(compare.line_diff("text", "following")).cast("long").alias("differences"))


_SQL_WORD = r"[\pL\pN_](?:\S*[\pL\pN_])?"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_SQL_WORD}') AS ws, regexp_split_to_array(text, '{_SQL_WORD}') AS gs FROM documents WHERE regexp_matches(text, '[A-Z][a-z]')),
n AS (SELECT DISTINCT ws[1] AS name FROM t WHERE len(ws) > 0),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(gs[:len(ws)]) AS gap, generate_subscripts(ws, 1) AS i FROM t),
p AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM w),
h AS (SELECT p.* FROM p JOIN n ON name = word WHERE word[1] <> lower(word[1])),
b AS (SELECT *, CASE WHEN lag(i) OVER o = i - 1 AND length(gap) <= 2 THEN 0 ELSE 1 END AS begins FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 3 AS part FROM r)
SELECT doc_id, CAST(min(stop - length(word)) AS BIGINT) AS start_at, CAST(max(stop) AS BIGINT) AS end_at, string_agg(word, ' ' ORDER BY i) AS original FROM k GROUP BY doc_id, run, part""")
def dictionary_names(spark, sf_dir):
    """Runs of up to three names; names are the words that any document begins with."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = documents.where(F.col("text").rlike("[A-Z][a-z]")).select(F.regexp_extract("text", r"(?U)\b\S+\b", 0).alias("name")).where("name <> ''").distinct()
    return _spans(detect.with_names(documents, "spans", names, "[A-Z][a-z]"), F.col("spans")).drop("entity_type")


@query()
def dictionary_phrases(spark, sf_dir):
    """The longest phrase at each place near a context; phrases are the first words of every document. Tests hold it against a plain search."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\S+\b"), F.lit(0))
    phrases = documents.select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, F.lit(1), n), " ")))).alias("phrase")).where("phrase is not null").distinct()
    return _spans(detect.with_vehicles(documents, "spans", phrases, ("en",), 40), F.col("spans")).drop("entity_type")


_LIFE = "(PARTITION BY session_id, life ORDER BY seq, op, moment, data ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'create' WHEN 'purchase' THEN 'update' WHEN 'logout' THEN 'delete' ELSE 'get' END AS op,
  epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS moment, props AS data FROM events),
l AS (SELECT *, sum((op = 'create')::INT) OVER (PARTITION BY session_id ORDER BY seq, op, moment, data ROWS UNBOUNDED PRECEDING) AS life FROM o),
k AS (SELECT *, life > 0 AND NOT coalesce(bool_or(op = 'delete') OVER (PARTITION BY session_id, life ORDER BY seq, op, moment, data ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  AND max(moment) OVER {_LIFE} <= first(moment) OVER {_LIFE} + 3600 AS ok, last_value(CASE WHEN op IN ('create', 'update') THEN data END IGNORE NULLS) OVER {_LIFE} AS held FROM l)
SELECT session_id, seq, op, ok, CASE WHEN ok AND op <> 'delete' THEN held END AS data FROM k""")
def review_sessions(spark, sf_dir):
    """Session operations from events: errors create, purchases update, logouts delete, others read; a session is a user's."""
    op = F.when(F.col("event_type") == "error", "create").when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "logout", "delete").otherwise("get")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), op.alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("props").alias("data"))
    return jobs.session_states(ops.withColumn("at", F.col("us") / 1e6).drop("us"))


_RU_ROWS = (
    (1, "Реквизиты сторон: ИНН 561234567801, затем ИНН 770123456789.", "Реквизиты сторон: [ИНН1], затем [ИНН2]."),
    (2, "звонить 89151112233", "звонить [СНИЛС1]"),
    (3, "Деньги ушли на 40702810500000001234, БИК 044030653", "Деньги ушли на [БАНК. СЧЁТ1], БИК [БИК1]"),
    (4, "Машина В456ОР178, кузов JTDBR32E720012345, бумага 99 ТО 765432", "Машина [ГОСНОМЕР1], кузов [VIN1], бумага [СТС1]"),
    (5, "К иску приложен полис ХХХ 0123456789", "К иску приложен полис [СТРАХ. ПОЛИС1]"),
    (6, 'АО "Северный ветер" отгрузило зерно, а ООО "Берёзка" не заплатило.', "[ОРГАНИЗАЦИЯ1] отгрузило зерно, а [ОРГАНИЗАЦИЯ2] не заплатило."),
    (7, "Доверенность выдал Соколов П.Н. ещё вчера.", "Доверенность выдал [ФИО1] ещё вчера."),
    (8, "Сроки, порядок приёмки и цену стороны определили сами.", "Сроки, порядок приёмки и цену стороны определили сами."),
    (9, "Соколов Пётр Николаевич внёс задаток. Позже Соколов забрал вещи. П.Н. Соколов расписался.",
     "[ФИО1] внёс задаток. Позже [ФИО1] забрал вещи. [ФИО1] расписался."),
)


def _every_customer(spark, sf_dir, rows, fields: str) -> DataFrame:
    """The rows for each customer: k and their fields."""
    names = [f.split()[0] for f in fields.split(", ")]
    cases = F.array(*[F.struct(*[F.lit(x).cast(f.split()[1]).alias(n) for n, f, x in zip(names, fields.split(", "), r)]) for r in rows])
    return spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))).select("k", F.inline(cases))


_K = "CAST(c_custkey AS BIGINT) AS k"


@query(f"SELECT {_K}, id, 'Лист ' || c_custkey || '. ' || anonymized_text AS anonymized_text FROM customer, (VALUES " + ", ".join("({}, '{}')".format(i, want.replace("'", "''")) for i, _, want in _RU_ROWS) + ") v(id, anonymized_text)")
def ru_fixture_anonymize(spark, sf_dir):
    """Sentences with what the whole transform makes of them, on a sheet of each customer's."""
    rows = _every_customer(spark, sf_dir, [(i, text) for i, text, _ in _RU_ROWS], "id int, sentence string").withColumn("text", F.concat(F.lit("Лист "), F.col("k").cast("string"), F.lit(". "), F.col("sentence")))
    return anonymize.anonymize(rows).select("k", "id", "anonymized_text")


@query(f"""SELECT {_K}, v.* FROM customer, (VALUES (1, 'accept', 'three_part_name'), (2, 'reject', 'generic_role_or_legal_term'), (3, 'accept', 'three_part_name'), (4, 'reject', 'ambiguous_single_token')) v(id, verdict, reason)""")
def ru_fixture_person_rules(spark, sf_dir):
    rows = _every_customer(spark, sf_dir, [(1, "Иванов Иван Иванович", 0.86), (2, "Договор Банк", 0.94), (3, "Иванов И.И.", 0.7), (4, "Марс", 0.5)], "id int, text string, confidence double")
    d = rules.decide_person(F.col("text"), F.lit(0), F.length("text"), F.col("text"), F.col("confidence"))
    return rows.select("k", "id", d.alias("d")).select("k", "id", "d.verdict", "d.reason")


@query(f"SELECT {_K}, v.* FROM customer, (VALUES (1, 'review', CAST(0.62 AS DOUBLE)), (2, 'accept', CAST(0.94 AS DOUBLE)), (3, 'reject', CAST(0.2 AS DOUBLE))) v(id, verdict, score)")
def ru_fixture_org_rules(spark, sf_dir):
    rows = _every_customer(spark, sf_dir, [(1, "Вектор Гранит", 0.7), (2, 'ООО "Ромашка"', 0.7), (3, "ООО", 0.9)], "id int, text string, confidence double")
    return rows.select("k", "id", rules.decide_org(F.col("text"), F.col("confidence")).alias("d")).select("k", "id", "d.verdict", "d.score")


@query(f"""SELECT {_K}, id, vehicle, CAST(start + length(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS start_at FROM customer, (VALUES (1, 'Toyota Camry', 27), (2, 'Haval F7', 6)) v(id, vehicle, start)""")
def ru_fixture_vehicles(spark, sf_dir):
    rows = _every_customer(spark, sf_dir, [(1, "у дома стояла машина Toyota Camry"), (2, "Haval F7, водитель которого скрылся"), (3, "завод Toyota открыл музей")], "id int, sentence string")
    found = detect.with_vehicles(rows.withColumn("text", F.concat(F.lit("Лист "), F.col("k").cast("string"), F.lit(" "), F.col("sentence"))), "spans")
    return found.select("k", "id", F.explode("spans").alias("s")).select("k", "id", F.col("s.original").alias("vehicle"), F.col("s.start").cast("long").alias("start_at"))


@query("""SELECT format(path, c_custkey) AS path, CASE WHEN text IS NULL THEN NULL ELSE format(text, c_custkey) END AS text, error FROM customer, (VALUES ('a{}.txt', 'Привет мир {}', NULL), ('b{}.rtf', 'Hello world {}', NULL), ('c{}.exe', NULL, 'unsupported'),
  ('d{}.txt', NULL, 'empty'), ('e{}.TXT', 'Ёлка {} — «да»', NULL), ('f{}.rtf', 'Суд {}', NULL), ('g{}.docx', NULL, 'unreadable: BadZipFile'), ('h{}.pdf', NULL, 'unsupported')) v(path, text, error)""")
def extract_fixture_files(spark, sf_dir):
    """Files of each customer: texts in two encodings, RTF with a font table and with bytes of a code page, and what can't be read."""
    rows = [("a", ".txt", "cp1251", "Привет мир ", ""), ("b", ".rtf", "latin1", "{\\rtf1 {\\fonttbl x;}Hello \\b world ", "}"), ("c", ".exe", "latin1", "MZ", ""), ("d", ".txt", "latin1", "  ", None), ("e", ".TXT", "utf-8", "Ёлка ", " — «да»"),
            ("f", ".rtf", "latin1", "{\\rtf1\\ansi\\ansicpg1251 \\'d1\\'f3\\'e4 ", "}"), ("g", ".docx", "latin1", "no archive ", ""), ("h", ".pdf", "latin1", "%PDF", "")]
    key = F.col("k").cast("string").cast("binary")
    files = _every_customer(spark, sf_dir, [(n, kind, bytearray(before.encode(page)), None if after is None else bytearray(after.encode(page))) for n, kind, page, before, after in rows], "n string, kind string, before binary, after binary")
    content = F.when(F.col("after").isNull(), F.col("before")).otherwise(F.concat("before", key, "after"))
    return docs_source.extract(files.select(F.concat("n", F.col("k").cast("string"), "kind").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content")))
