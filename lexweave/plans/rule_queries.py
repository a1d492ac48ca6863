"""Rules, numbering, restoring, review and highlighting over rows written from `customer` and `documents`; the SQL computes each outcome.

Every case is written for every customer k, with a confidence and texts that change with k.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import charset
from lexweave.functions.patterns import PATTERNS
from lexweave.operators import anonymize, detect, evaluate, lemmas, recognize, render, rules
from lexweave.plans.queries import query
from lexweave.session import spread, table
from lexweave.sources import documents, exports, store
from lexweave.sources.exports import pdf_file
from lexweave.streaming import cases


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What stands before a name, the name, whether a fact about it is known, and its outcome: (reason, bonus, penalty), a rejection's score as bonus and no
# penalty; the second outcome counts from a confidence of the last number on.
_PEOPLE = [
    ("", "", False, ("empty", 0.0, None), None), ("", "12 34", False, ("no_name_tokens", 0.0, None), None), ("", "Договор Банк", False, ("generic_role_or_legal_term", 0.2, None), None),
    ("", "Стол Лампа Шкаф", False, ("non_person_three_part_sequence", 0.12, None), None), ("", "Стол Лампа Шкаф", True, ("three_part_name", 0.36, 0.0), None),
    ("", "Алеев Иван Иванович", False, ("three_part_name", 0.32, 0.0), None), ("", "Марс Иван Олегович", True, ("three_part_name", 0.48, 0.0), None), ("", "Алеев Стол Лампа", False, ("three_part_name", 0.24, 0.0), None),
    ("", "Алеев И.И.", False, ("three_part_name", 0.24, 0.0), None), ("истец ", "Марс Сатурн", False, ("two_part_name_with_context", 0.14, 0.0), None),
    ("", "Алеев Сатурн", False, ("ambiguous_two_part_name", 0.0, 0.08), ("borderline_two_part_name", 0.05, 0.0, 0.9)), ("", "Алеев Сатурн", True, ("borderline_two_part_name", 0.21, 0.0), None),
    ("", "Марс Сатурн", False, ("ambiguous_two_part_name", 0.0, 0.08), None), ("", "Директор", False, ("generic_role_or_legal_term", 0.2, None), None),
    ("истец ", "Алеев", False, ("single_token_with_context", 0.12, 0.0), None), ("истец ", "Марс", False, ("ambiguous_single_token", 0.0, 0.15), ("single_token_with_context", 0.12, 0.0, 0.93)),
    ("истец ", "Марс", True, ("single_token_with_context", 0.28, 0.0), None), ("", "Марс", False, ("ambiguous_single_token", 0.0, 0.15), None),
]
_ORGANISATIONS = [
    ("", "", False, ("empty", 0.0, None), None), ("", "ООО", False, ("bare_org_form", 0.2, None), None), ("", "Компания", False, ("generic_role_only_org", 0.05, None), None), ("", "Суд Вектор", False, ("legal_stopword", 0.25, None), None),
    ("", 'ООО "Вектор"', False, ("short_form_with_name", 0.24, 0.0), None), ("", "АО Вектор Гранит", False, ("short_form_with_name", 0.24, 0.0), None), ("", "ИПотека", False, ("short_form_without_distinctive_name", 0.08, None), None),
    ("", "Общество с ограниченной ответственностью Вектор", False, ("long_form_org", 0.28, 0.0), None), ("", "Банк Вектор Плюс", False, ("keyword_org", 0.16, 0.0), None),
    ("", "Вектор Гранит", False, ("ambiguous_org", 0.0, 0.08), ("high_confidence_org", 0.05, 0.0, 0.9)), ("", "Вектор", False, ("ambiguous_org", 0.0, 0.08), None),
]
_PLACES = [
    ("", "", False, ("empty", 0.0, None), None), ("", "Россия", False, ("generic_country", 0.05, None), None), ("", "ГИТ", False, ("short_upper_acronym", 0.1, None), None), ("по адресу ", "ГИТ", False, ("context_boost", 0.18, 0.0), None),
    ("", "ул. Мира, д. 5", False, ("structural_address", 0.24, 0.0), None), ("", "644001", False, ("structural_address", 0.24, 0.0), None), ("проживает по адресу ", "Омск", False, ("context_boost", 0.18, 0.0), None),
    ("", "Омск", False, ("ambiguous_loc", 0.0, 0.15), ("bare_loc_high_confidence", 0.0, 0.05, 0.88)),
]
# Accepted from, reviewed from, least confidence.
_THRESHOLDS = {"PER": (0.78, 0.62, 0.42), "ORG": (0.77, 0.6, 0.48), "АДРЕС": (0.72, 0.55, 0.48)}


def _decided(spark: SparkSession, sf_dir: str, cases: list, decide) -> DataFrame:
    every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(before).alias("before"), F.lit(name).alias("name"), F.lit(fact).alias("fact")) for n, (before, name, fact, *_) in enumerate(cases)])
    rows = _customers(spark, sf_dir).select("k", F.inline(every)).withColumn("confidence", (F.col("k") % 70 + 30) / 100)
    rows = rows.withColumns({"text": F.concat(F.lit("Запись "), F.col("k").cast("string"), F.lit(": "), F.col("before"), F.col("name"), F.lit(" — конец")),
                             "start": F.length(F.col("k").cast("string")) + 9 + F.length("before")})
    decided = rows.select("k", "n", decide(F.col("text"), F.col("start"), F.col("start") + F.length("name"), F.col("name"), F.col("confidence"), F.col("fact")).alias("d"))
    return decided.select(F.col("k").alias("id"), F.col("n").cast("long").alias("case"), "d.verdict", "d.reason", F.round("d.score", 6).alias("score"))


def _outcomes(kind: str, cases: list) -> str:
    accept, review, least = _THRESHOLDS[kind]
    show = lambda x: "NULL" if x is None else repr(x) if isinstance(x, float) else _sql(x)
    rows = ", ".join(f"({n}, {', '.join(map(show, low))}, {', '.join(map(show, high or (None,) * 4))})" for n, (*_, low, high) in enumerate(cases))
    return f"""WITH v AS (SELECT * FROM (VALUES {rows}) v(n, reason, bonus, penalty, reason2, bonus2, penalty2, since)),
c AS (SELECT CAST(c_custkey AS BIGINT) AS k, (c_custkey % 70 + 30) / 100 AS confidence FROM customer),
o AS (SELECT k, n, greatest(confidence, {least}) AS base, CASE WHEN confidence >= since THEN reason2 ELSE reason END AS reason, CASE WHEN confidence >= since THEN bonus2 ELSE bonus END AS bonus,
  CASE WHEN confidence >= since THEN penalty2 ELSE penalty END AS penalty FROM c, v),
s AS (SELECT *, CASE WHEN penalty IS NULL THEN CAST(bonus AS DOUBLE) ELSE greatest(0.0, least(1.0, round(CAST(base AS DOUBLE) + CAST(bonus AS DOUBLE) - CAST(penalty AS DOUBLE), 6))) END AS score FROM o)
SELECT k AS id, CAST(n AS BIGINT) AS "case", CASE WHEN penalty IS NULL THEN 'reject' WHEN score >= {accept} THEN 'accept' WHEN score >= {review} THEN 'review' ELSE 'reject' END AS verdict, reason, score FROM s"""


@query(_outcomes("PER", _PEOPLE))
def person_decisions(spark, sf_dir):
    """Names of people, by parts, context, facts and confidence."""
    return _decided(spark, sf_dir, _PEOPLE, rules.decide_person)


@query(_outcomes("ORG", _ORGANISATIONS))
def organisation_decisions(spark, sf_dir):
    """Names of organisations, by form, keywords and confidence."""
    return _decided(spark, sf_dir, _ORGANISATIONS, lambda text, start, end, name, confidence, fact: rules.decide_org(name, confidence))


@query(_outcomes("АДРЕС", _PLACES))
def address_decisions(spark, sf_dir):
    """Places that a recogniser gave, by parts, context and confidence."""
    return _decided(spark, sf_dir, _PLACES, lambda text, start, end, name, confidence, fact: rules.decide_address(text, start, end, name, confidence, F.lit("ner")))


# Two addresses, the first one twice; every second text spells a token itself.
_LETTER = "concat('<b>Пишите</b> a', {k}, '@x.ru & b', {k}, '@x.ru, снова a', {k}, '@x.ru', CASE WHEN {k} % 2 = 1 THEN ' (не [EMAIL_001])' ELSE '' END)"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(_LETTER.format(k="k")).alias("text"))


@query(f"""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_LETTER.format(k='c_custkey')} AS text, 'a' || c_custkey || '@x.ru' AS a, 'b' || c_custkey || '@x.ru' AS b,
  CASE WHEN c_custkey % 2 = 1 THEN '[EMAIL_002]' ELSE '[EMAIL_001]' END AS ta, CASE WHEN c_custkey % 2 = 1 THEN '[EMAIL_003]' ELSE '[EMAIL_002]' END AS tb FROM customer)
SELECT doc_id, replace(replace(text, a, ta), b, tb) AS by_type, replace(replace(text, a, '[EMAIL_1]'), b, '[EMAIL_2]') AS by_one, true AS restored FROM t""")
def token_numbers(spark, sf_dir):
    """Tokens are numbered from the right, by type or by one counter; equal originals share one, numbers that the text spells are passed over."""
    letters = _letters(spark, sf_dir)
    by_type = anonymize.deanonymize(anonymize.anonymize_tokens(letters, dictionaries=False))
    by_one = anonymize.anonymize_tokens(by_type.select("doc_id", "text", F.col("anonymized_text").alias("by_type"), (F.col("restored_text") == F.col("text")).alias("restored")), dictionaries=False, counter="all")
    return by_one.select("doc_id", "by_type", F.col("anonymized_text").alias("by_one"), "restored")


@query("SELECT doc_id, true AS restored FROM documents")
def tokens_spelt_in_texts(spark, sf_dir):
    """Documents that spell tokens themselves come back as they were."""
    spelt = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[EMAIL_001] [EMAIL_003] [PHONE_001] "), F.coalesce("text", F.lit("")), F.lit(" x@y.ru [BANK_CARD_002] [EMAIL_002]")).alias("text"))
    out = anonymize.deanonymize(anonymize.anonymize_tokens(spelt, dictionaries=False))
    return out.select("doc_id", ((F.col("restored_text") == F.col("text")) & (F.col("anonymized_text") != F.col("text"))).alias("restored"))


@query(f"""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_LETTER.format(k='c_custkey')} AS text, 'a' || c_custkey || '@x.ru' AS a, 'b' || c_custkey || '@x.ru' AS b FROM customer)
SELECT doc_id, replace(replace(text, a, '[EMAIL1]'), b, '[EMAIL2]') AS anonymized_text, CAST(3 AS BIGINT) AS total_replacements, a || ';' || b || ';' || a AS emails FROM t""")
def numbered_placeholders(spark, sf_dir):
    """Placeholders are numbered from the left by type; what was found is listed in order, repeats included."""
    out = anonymize.anonymize(_letters(spark, sf_dir), dictionaries=False)
    return out.select("doc_id", "anonymized_text", F.col("total_replacements").cast("long").alias("total_replacements"), F.array_join(F.element_at("entities_found", F.lit("EMAIL")), ";").alias("emails"))


@query(f"""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_LETTER.format(k='c_custkey')} AS text, 'a' || c_custkey || '@x.ru' AS a, 'b' || c_custkey || '@x.ru' AS b, CASE WHEN c_custkey % 2 = 1 THEN '[EMAIL_003]' ELSE '[EMAIL_002]' END AS tb FROM customer)
SELECT doc_id, replace(replace(text, b, tb), 'снова', '[PERSON_MANUAL]') AS approved FROM t""")
def review_gate(spark, sf_dir):
    """Of three spans the second alone is selected; a word marked by hand is replaced as well."""
    out = anonymize.anonymize_tokens(_letters(spark, sf_dir), dictionaries=False)
    second = F.array(anonymize.span_id(F.element_at("spans", 2)))
    return out.select("doc_id", render.approved_text(F.col("text"), F.col("spans"), second, F.lit("снова"), F.lit("PERSON")).alias("approved"))


@query(f"""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_LETTER.format(k='c_custkey')} AS text, '(a|b)' || c_custkey || '@x[.]ru' AS p FROM customer)
SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), p, '<mark class="pdn" title="EMAIL">\\1' || doc_id || '@x.ru</mark>', 'g') AS spans,
  replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[EMAIL_001]', '<mark class="token">[EMAIL_001]</mark>') AS tokens FROM t""")
def highlighted(spark, sf_dir):
    """Texts as HTML with what was found, and with tokens, marked; all else is escaped."""
    specs = [s for s in PATTERNS["rules"] if s.entity_type == "EMAIL"]
    found = _letters(spark, sf_dir).withColumn("found", detect.regex_candidates("text", specs=specs))
    return found.select("doc_id", render.highlight_spans(F.col("text"), F.col("found")).alias("spans"), render.highlight_tokens(F.col("text")).alias("tokens"))


# Words of the documents that other words lengthen by at most three letters teach the rules; every word then gets a lemma.
_SQL_WORDS = r"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


@query(f"""WITH w AS ({_SQL_WORDS}),
p AS (SELECT DISTINCT f.word AS form, l.word AS lemma FROM w f, (SELECT unnest([1, 2, 3]) AS n) s, w l WHERE length(f.word) >= n + 4 AND l.word = left(f.word, length(f.word) - n)),
r AS (SELECT form, CAST(length(form) - length(lemma) AS INTEGER) AS cut FROM p),
e AS (SELECT cut, unnest(list_distinct(list_concat([0], range(cut, least(length(form), cut + 4) + 1)))) AS n, form FROM r),
v AS (SELECT right(form, n) AS ending, n, cut, count(*) AS forms FROM e WHERE n >= cut GROUP BY ALL),
b AS (SELECT ending, any_value(n) AS n, sum(forms) AS every, arg_min(cut, {{'f': -forms, 'c': cut}}) AS cut FROM v GROUP BY ending),
k AS (SELECT w.word, b.cut, row_number() OVER (PARTITION BY w.word ORDER BY b.n DESC) AS place FROM w JOIN b ON b.every >= 2 AND b.ending = right(w.word, b.n) AND b.n <= length(w.word))
SELECT w.word, CASE WHEN cut IS NULL THEN w.word ELSE left(w.word, length(w.word) - cut) END AS lemma FROM w LEFT JOIN k ON k.word = w.word AND place = 1""")
def learned_lemmas(spark, sf_dir):
    """Lemmas of all words of the documents, by rules learned from those of them that are others with up to three letters more."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    words = table(spark, sf_dir, "documents").select(found).distinct()
    longer = words.select(F.col("word").alias("form"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).where(F.length("form") >= F.col("n") + 4)
    forms = longer.withColumn("lemma", F.left("form", F.length("form") - F.col("n"))).join(words.select(F.col("word").alias("lemma")), "lemma").select("form", "lemma")
    return lemmas.lemmatize(words, lemmas.learn(forms))


_FAMILY = "concat(substr('БорВолГорДемЖарЗубЛобМарНикПан', 1 + 3 * (k % 10), 3), CASE k % 3 WHEN 0 THEN 'ов' WHEN 1 THEN 'енко' ELSE 'ский' END)"
_GIVEN = "CASE k % 5 WHEN 0 THEN 'Иван' WHEN 1 THEN 'Олег' WHEN 2 THEN 'Игорь' WHEN 3 THEN 'Семён' ELSE 'Павел' END"
_FIRM = "concat(CASE k % 2 WHEN 0 THEN 'ООО' ELSE 'АО' END, ' «', substr('ВектМаякГранРодиСпекКаск', 1 + 4 * (k % 6), 4), 'ор»')"
_TOWN = "substr('Омск  Томск Пермь Уфа   Тверь Псков ', 1 + 6 * (k % 6), 6)"


@query()
def recogniser_quality(spark, sf_dir):
    """Precision and recall of a recogniser that half of the customers' sentences teach, on the other half; tests hold its parts against other ways."""
    parts = [
        [("Истец ", None), (f"concat({_FAMILY}, ' ', {_GIVEN})", "PER"), (" просит взыскать долг с ", None), (_FIRM, "ORG"), (".", None)],
        [("По делу выступил ", None), (f"concat({_FAMILY}, ' И.П.')", "PER"), (", представитель ", None), (_FIRM, "ORG"), (".", None)],
        [("В город ", None), (f"trim({_TOWN})", "АДРЕС"), (" прибыл ", None), (f"concat({_GIVEN}, ' ', {_FAMILY})", "PER"), (" и осмотрел товар.", None)],
    ]
    made = []
    for sentence in parts:
        said = [F.lit(x) if kind is None else F.expr(x) for x, kind in sentence]
        length = lambda some: F.length(F.concat(F.lit(""), *some))
        spans = F.array(*[F.struct(length(said[:n]).alias("start"), length(said[: n + 1]).alias("end"), F.lit(kind).alias("entity_type")) for n, (_, kind) in enumerate(sentence) if kind])
        made.append(F.struct(F.concat(*said).alias("text"), spans.alias("spans")))
    rows = _customers(spark, sf_dir).select("k", F.posexplode(F.array(*made)).alias("n", "s")).select("k", "n", "s.*")
    tagger = recognize.fit(rows.where("k % 2 = 1"))
    found = recognize.recognize(rows.where("k % 2 = 0"), tagger)
    listed = lambda c: found.select("k", "n", F.inline(c)).select("k", "n", "entity_type", "start", "end")
    return evaluate.span_precision_recall(listed("spans"), listed("ner"), ("k", "n", "entity_type"))


@query("""WITH d AS (SELECT CAST(c_nationkey AS VARCHAR) AS case_id, CAST(c_custkey AS BIGINT) AS k, 'a' || c_custkey % 7 || '@x.ru' AS x, 'b' || c_custkey || '@y.ru' AS y FROM customer),
m AS (SELECT case_id, x AS e, k, 1 AS p FROM d UNION ALL SELECT case_id, y, k, 2 FROM d), f AS (SELECT case_id, e, min({'k': k, 'p': p}) AS first FROM m GROUP BY case_id, e),
n AS (SELECT case_id, e, '[EMAIL' || row_number() OVER (PARTITION BY case_id ORDER BY first) || ']' AS said FROM f)
SELECT d.case_id, k AS doc_id, 'Письмо: ' || a.said || ', копия ' || b.said AS anonymized_text, CAST(2 AS BIGINT) AS total_replacements FROM d JOIN n a ON a.case_id = d.case_id AND a.e = x JOIN n b ON b.case_id = d.case_id AND b.e = y""")
def case_numbers(spark, sf_dir):
    """Letters of all customers of a nation share the numbers of their addresses, by customer."""
    letters = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("doc_id"),
                                                      F.expr("concat('Письмо: a', c_custkey % 7, '@x.ru, копия b', c_custkey, '@y.ru')").alias("text"))
    return cases.anonymize_cases(letters, dictionaries=False).select("case_id", "doc_id", "anonymized_text", F.col("total_replacements").cast("long").alias("total_replacements"))


@query("""SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE regexp_matches(text, '^[\\x00-\\x7F]*$')""")
def charset_of_plain_texts(spark, sf_dir):
    """Texts that all pages write alike come back whatever is learned."""
    texts = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("doc_id", "text")
    files = texts.select("doc_id", F.encode("text", "utf-8").alias("content"))
    return charset.with_charset(files, charset.learn(texts)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, 'Истец ' || c_custkey || ' просит взыскать задолженность по договору поставки, заключённому с ответчиком ' || c_custkey * 7 AS text FROM customer""")
def charset_of_letters(spark, sf_dir):
    """Russian letters of all customers, each in one of five encodings, read back by byte pairs that half of them teach."""
    letters = _customers(spark, sf_dir).withColumn("said", F.concat(F.lit("Истец "), F.col("k").cast("string"), F.lit(" просит взыскать задолженность по договору поставки, заключённому с ответчиком "), (F.col("k") * 7).cast("string")))
    pages = ("utf-8", *charset.PAGES[:4])

    def write(text: pa.Array, page: pa.Array) -> pa.Array:
        return pa.array([t.encode(pages[p]) for t, p in zip(text.to_pylist(), page.to_pylist())], pa.binary())

    files = letters.withColumn("content", F.arrow_udf(write, "binary")(F.col("said"), (F.col("k") % len(pages)).cast("int")))
    model = charset.learn(letters.where("k % 2 = 1"), column="said")
    return charset.with_charset(files, model).select(F.col("k").alias("id"), "text")


@query("""SELECT 'c' || c_custkey || '.pdf' AS path, 'Договор № ' || c_custkey || chr(10) || 'Покупатель ' || c_name || ' платит ' || c_custkey * 3 || ' руб.' || chr(10) || chr(10) || 'Подпись: ' || c_mktsegment AS text, NULL AS error FROM customer""")
def pdf_contracts(spark, sf_dir):
    """A contract of two pages for each customer, its pieces drawn out of order, read back."""
    def write(key: pa.Array, name: pa.Array, phone: pa.Array) -> pa.Array:
        made = [pdf_file([[(72.0, 700.0, f"Покупатель {n}"), (72.0, 720.0, "Договор №"), (72.0 + 5 * (13 + len(n)), 700.0, f"платит {3 * k} руб."), (140.0, 721.0, f"{k}")], [(72.0, 720.0, "Подпись: "), (130.0, 720.0, p)]])
                for k, n, p in zip(key.to_pylist(), name.to_pylist(), phone.to_pylist())]
        return pa.array(made, pa.binary())

    named = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    customers = named.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"), F.arrow_udf(write, "binary")(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")).alias("content"))
    return documents.pdf_text(customers)


def _case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of each customer with one law and the text of its report."""
    law = F.array(F.struct(F.lit("Закон").alias("title"), F.concat(F.lit("ст. "), F.col("k").cast("string")).alias("article"), F.lit(None).cast("string").alias("text")))
    case = F.struct(F.col("k").alias("id"), F.concat(F.lit("файл "), F.col("k").cast("string")).alias("filename"), F.lit(None).cast("string").alias("created_at"), F.lit("demo").alias("source"), F.lit("Краткий вывод & <итог>").alias("legal_summary"),
                    F.lit(None).cast("string").alias("recommendations"), law.alias("relevant_laws"), F.array().cast("array<struct<case:string,court:string,outcome:string>>").alias("court_practice"), F.concat(F.lit("текст "), F.col("k").cast("string")).alias("anonymized_text"))
    return _customers(spark, sf_dir).select("k", store.report(case).alias("report"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, true AS docx, true AS pdf, true AS long_pdf FROM customer")
def exported_reports(spark, sf_dir):
    """Reports as DOCX and PDF files, which hold the lines of the report when they are read again."""
    cases = _case(spark, sf_dir)
    long = F.repeat(F.concat("report", F.lit("\n")), 6)
    # Lines with single blanks inside and none at their ends; empty ones are left out.
    lines = lambda text: F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+", " "), "(?: ?\n ?)+", "\n"), F.lit(" \n"))

    def written(kind: str, end: str, content: Column) -> DataFrame:
        # A table for each kind: a reader of one has no others written.
        return cases.select(F.concat(F.lit(kind), F.col("k").cast("string"), F.lit(end)).alias("path"), content.alias("content"))

    docx = written("d", ".docx", exports.docx_file("report")).select("path", F.length("content").cast("long").alias("length"), "content")
    pdf = written("p", ".pdf", exports.pdf_pages("report")).union(written("l", ".pdf", exports.pdf_pages(long)))
    found = documents.extract(docx).union(documents.extract_pdf(pdf))
    read = found.select(F.left("path", F.lit(1)).alias("kind"), F.regexp_extract("path", r"\d+", 0).cast("long").alias("k"), "text")
    held = read.groupBy("k").pivot("kind", ["d", "p", "l"]).agg(F.first("text"))
    same = cases.join(held, "k")
    return same.select(F.col("k").alias("id"), (lines(F.col("report")) == lines(F.col("d"))).alias("docx"), (lines(F.col("report")) == lines(F.col("p"))).alias("pdf"), (lines(long) == lines(F.col("l"))).alias("long_pdf"))


_SQL_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\x0b\\x0c]+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT doc_id, sha256(array_to_string({_SQL_LINES}, chr(10) || chr(10))) AS text_sha256 FROM documents WHERE len({_SQL_LINES}) > 0 AND length(text) < 100000")
def docx_round_trip(spark, sf_dir):
    """Documents as DOCX files, a paragraph a line, words cut between runs, read back."""
    kept = table(spark, sf_dir, "documents").where((F.col("text").rlike(r"\S")) & (F.length("text") < 100_000))
    files = kept.select("doc_id", exports.docx_file("text", run=7).alias("content"))
    return files.select("doc_id", documents.zipped_text(F.col("content"), F.lit(".docx"))["text"].alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"))


@query(f"""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {_LETTER.format(k='c_custkey')} AS text, 'a' || c_custkey || '@x.ru' AS a, 'b' || c_custkey || '@x.ru' AS b FROM customer)
SELECT doc_id, replace(replace(text, a, '[EMAIL1]'), b, '[EMAIL2]') AS text, a || ',' || b || ',' || a AS emails, CAST(3 AS BIGINT) AS total, '' AS warning FROM t""")
def json_responses(spark, sf_dir):
    """What a caller gets as JSON, taken apart again."""
    said = render.json_response(anonymize.anonymize(_letters(spark, sf_dir), dictionaries=False))
    parsed = said.select("doc_id", F.from_json("response", "anonymized_text string, entities_found map<string,array<string>>, total_replacements bigint, warnings array<string>").alias("r"))
    return parsed.select("doc_id", F.col("r.anonymized_text").alias("text"), F.array_join(F.element_at("r.entities_found", F.lit("EMAIL")), ",").alias("emails"), F.col("r.total_replacements").alias("total"), F.array_join("r.warnings", ";").alias("warning"))
