import pytest
from pyspark.sql import functions as F

from lexweave.operators import detect, render, rules
from lexweave.operators.anonymize import anonymize, anonymize_tokens, deanonymize
from lexweave.plans.queries import _RU_ROWS
from lexweave.streaming.jobs import anonymize_stream

ALL = ("ИНН 123456789012, СНИЛС 123-456-789 00, тел. +7 (999) 123-45-67, паспорт 45 06 123456, email: test@example.ru, р/с 40817810099910004312, БИК 044525225, "
       "карта 4276 1234 5678 9012, госномер А123ВС777, VIN 1HGBH41JXMN109186, ОСАГО ТТТ 1234567890, СТС 77 МА 123456")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="module")
def numbered(spark):
    rows = anonymize(docs(spark, *[t for _, t, _ in _RU_ROWS], ALL, None, "  ", "Гражданин Иванов Иван Иванович подал заявление. 119019, г. Москва, ул. Арбат, д. 12", "а/м Toyota Camry г/н А123ВС77")).orderBy("doc_id").collect()
    return rows


def test_numbered_placeholders(numbered):
    for (_, _, want), row in zip(_RU_ROWS, numbered):
        assert row["anonymized_text"] == want


def test_records_point_into_both_texts(numbered):
    for row in numbered:
        for r in row["replacements"]:
            assert row["anonymized_text"][r["start"] : r["end"]] == r["placeholder"]
            assert r["source"] == "dict" or row["text"][r["text_start"] : r["text_end"]] == r["original"] or r["original"] in row["text"]
        assert row["total_replacements"] == len(row["replacements"]) == sum(map(len, row["entities_found"].values()))


def test_blank_and_mixed(numbered):
    n = len(_RU_ROWS)
    assert numbered[n]["total_replacements"] == 12
    assert numbered[n + 1]["anonymized_text"] == "" and numbered[n + 1]["warnings"]
    assert numbered[n + 3]["anonymized_text"] == "Гражданин [ФИО1] подал заявление. [АДРЕС1]"
    assert numbered[n + 4]["anonymized_text"] == "а/м [МАРКА/МОДЕЛЬ ТС1] г/н [ГОСНОМЕР1]"


def test_tokens_round_trip(spark):
    texts = [ALL, "ИНН 123456789012 и снова ИНН 123456789012", "ИНН 123456789012 и ИНН 500100732259", "Прошу разъяснить порядок обжалования.", None]
    rows = deanonymize(anonymize_tokens(docs(spark, *texts))).orderBy("doc_id").collect()
    assert [r["restored_text"] for r in rows] == [t or "" for t in texts]
    assert len(rows[0]["mapping"]) == 12 and not any(o in rows[0]["anonymized_text"] for o in rows[0]["mapping"].values())
    assert rows[1]["anonymized_text"].count("[INN_001]") == 2
    assert rows[2]["anonymized_text"] == "ИНН [INN_002] и ИНН [INN_001]"
    assert rows[3]["anonymized_text"] == texts[3] and rows[0]["sources"]["regex"] == 12
    one = anonymize_tokens(docs(spark, "ИНН 123456789012, БИК 044525225"), counter="all").first()
    assert one["anonymized_text"] == "ИНН [INN_2], БИК [BIK_1]"


def test_model_replies(spark):
    reply = '```json\n[{"type": "PERSON", "text": "Пётр", "start": 0, "end": 4}, {"type": "PERSON", "text": "Пётр", "start": 2, "end": 6}, {"type": "X"}]\n```'
    rows = spark.createDataFrame([(1, "Пётр пришёл", reply), (2, "Пётр", "не JSON"), (3, "Пётр", None)], "doc_id long, text string, reply string")
    out = {r["doc_id"]: r for r in anonymize_tokens(rows, dictionaries=False, llm="reply").collect()}
    assert out[1]["anonymized_text"] == "[PERSON_001] пришёл" and not out[1]["degraded"]
    assert out[2]["anonymized_text"] == "Пётр" and out[2]["degraded"] and out[3]["degraded"]


def test_recogniser_candidates(spark):
    text = "Истец Иванов Иван Иванович подал иск. Вектор Гранит молчит. Истец против. Россия."
    at = lambda s: (text.index(s), text.index(s) + len(s))
    ner = [(*at("Иванов"), "PER", 0.86, False), (*at("Вектор Гранит"), "ORG", 0.7, False), (*at("Россия"), "LOC", 0.9, False)]
    row = anonymize(spark.createDataFrame([(1, text, ner)], f"doc_id long, text string, ner {rules.NER}"), dictionaries=False, ner="ner").first()
    assert row["anonymized_text"].startswith("Истец [ФИО1] подал иск.")
    assert [(c["original"], c["verdict"], c["score"]) for c in row["review_candidates"]] == [("Вектор Гранит", "review", 0.62)]
    assert "Россия" in row["anonymized_text"]


def test_address_growth(spark):
    text = "Адрес: 119019, г. Москва, ул. Арбат, д. 12, кв. 5. Далее текст"
    s = text.index("Москва")
    g = spark.range(1).select(rules.grow_address(F.lit(text), F.lit(s), F.lit(s + 6)).alias("g")).first()["g"]
    assert text[g["start"] : g["end"]].endswith("ул. Арбат, д. 12, кв. 5")


def test_names_and_vehicles(spark):
    names = {r["doc_id"]: [s["original"] for s in r["spans"]] for r in detect.name_candidates(docs(spark, "гражданин Армен Карапетян тут", "Иванов Иван Иванович Петров", "нет имён", "Иван    Петров")).collect()}
    assert names == {0: ["Армен Карапетян"], 1: ["Иванов Иван Иванович", "Петров"], 3: ["Иван", "Петров"]}
    table = spark.createDataFrame([("Zaphod",)], "name string")
    assert detect.name_candidates(docs(spark, "Meet Zaphod now"), table, gate="[A-Z]").first()["spans"][0]["original"] == "Zaphod"
    cars = detect.vehicle_candidates(docs(spark, "Toyota Land Cruiser и автомобиль", "Toyota хороша")).collect()
    assert [(r["doc_id"], r["spans"][0]["original"]) for r in cars] == [(0, "Toyota Land Cruiser")]


def test_ids_play_no_part(spark):
    """Equal and null ids: each row keeps its own spans, whatever the size of the dictionary."""
    rows = [(1, "Смирнов Олег пришёл"), (1, "Другой текст, а Смирнов Олег здесь"), (None, "Смирнов Олег и машина Toyota Camry"), (None, "нет"), (2, None)]
    want = ["Другой текст, а [ФИО1] здесь", "[ФИО1] и машина [МАРКА/МОДЕЛЬ ТС1]", "[ФИО1] пришёл", "нет", ""]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([("Смирнов",), ("Олег",), (None,)], "name string")
    assert sorted(r["anonymized_text"] for r in anonymize(frame).collect()) == sorted(want)
    before, detect.MAX_BROADCAST_ROWS = detect.MAX_BROADCAST_ROWS, 1
    try:
        assert sorted(r["anonymized_text"] for r in anonymize(frame, names=table).collect()) == sorted(want)
    finally:
        detect.MAX_BROADCAST_ROWS = before


def test_restore_is_one_pass(spark):
    rows = spark.createDataFrame([("[INN_001] и [INN_002]", {"[INN_001]": "[INN_002]", "[INN_002]": "7"})], "t string, m map<string,string>")
    assert rows.select(render.restore(F.col("t"), F.col("m")).alias("r")).first()["r"] == "[INN_002] и 7"


def test_review_and_highlight(spark):
    out = anonymize_tokens(docs(spark, "ИНН 123456789012 & БИК 044525225"), dictionaries=False)
    ids = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["source"], s["entity_type"]))
    r = out.select(
        render.approved_text(F.col("text"), F.col("spans"), F.slice(ids, 1, 1)).alias("one"),
        render.approved_text(F.col("text"), F.col("spans"), F.array().cast("array<string>"), F.lit("ИНН"), F.lit("PERSON")).alias("manual"),
        render.highlight_spans(F.col("text"), F.col("spans")).alias("html"), render.highlight_tokens(F.col("anonymized_text")).alias("tokens")).first()
    assert r["one"] == "ИНН [INN_001] & БИК 044525225"
    assert r["manual"] == "[PERSON_MANUAL] 123456789012 & БИК 044525225"
    assert '<mark class="pdn" title="INN">123456789012</mark> &amp; БИК' in r["html"]
    assert '<mark class="token">[INN_001]</mark>' in r["tokens"]


def test_stream_equals_batch(spark, tmp_path):
    rows = docs(spark, ALL, "БИК 044525225", None)
    rows.write.parquet(str(tmp_path / "in"))
    stream = anonymize_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.select("doc_id", "anonymized_text").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in anonymize_stream(rows).select("doc_id", "anonymized_text").collect()}


def test_sql_functions(spark):
    from lexweave.functions import sql
    from lexweave.functions.patterns import PatternSpec

    docs(spark, ALL, "ничего", "it's 044525225").createOrReplaceTempView("some_documents")
    sql.register(spark)
    rows = spark.sql("SELECT doc_id, s.* FROM (SELECT doc_id, pii_spans(text) AS spans FROM some_documents) LATERAL VIEW explode(spans) AS s WHERE s.entity_type = 'БИК' ORDER BY doc_id").collect()
    assert [(r["doc_id"], r["original"]) for r in rows] == [(0, "044525225"), (2, "044525225")]
    assert ALL[rows[0]["start"] : rows[0]["end"]] == "044525225"
    sql.register(spark, [PatternSpec("QUOTE", "it's")])
    assert [r[0] for r in spark.sql("SELECT pii_count(text) FROM some_documents ORDER BY doc_id").collect()] == [0, 0, 1]
