"""Cases: numbers shared by a case's documents; a stream gives what the table gives."""

import pytest

from lexweave.streaming.cases import anonymize_cases

DOCUMENTS = "case_id string, seq long, doc_id long, text string"
ROWS = [
    ("a", 1, 10, "Пишите anna@x.ru или +7 912 345-67-89."), ("a", 2, 11, "Адреса: boris@x.ru, anna@x.ru; ИНН 7701234567."), ("b", 1, 12, "Отвечает boris@x.ru."),
    ("a", 3, 13, "Снова anna@x.ru, ИНН 7701234567 и 8 912 345 67 89, vera@x.ru."), (None, 1, 14, "vera@x.ru"), (None, None, 15, "anna@x.ru vera@x.ru"), ("b", 2, None, None), ("b", 3, 17, ""), ("b", 3, 17, "gleb@x.ru boris@x.ru"),
]
WANT = {
    (None, 15): "[EMAIL1] [EMAIL2]", (None, 14): "[EMAIL2]", ("a", 10): "Пишите [EMAIL1] или [ТЕЛЕФОН1].", ("a", 11): "Адреса: [EMAIL2], [EMAIL1]; [ИНН1].", ("b", 12): "Отвечает [EMAIL1].",
    ("a", 13): "Снова [EMAIL1], [ИНН1] и [ТЕЛЕФОН2], [EMAIL3].",
}


def test_table(spark):
    df = spark.createDataFrame(ROWS, DOCUMENTS).selectExpr("*", "1 AS row", "'x' AS placed", "2 AS spans").repartition(3)
    out = anonymize_cases(df).collect()
    got = {(r["case_id"], r["doc_id"]): r["anonymized_text"] for r in out}
    assert len(out) == len(ROWS) and {k: got[k] for k in WANT} == WANT
    assert sorted(r["anonymized_text"] for r in out if r["case_id"] == "b" and r["seq"] > 1) == ["", "", "[EMAIL2] [EMAIL1]"]
    assert anonymize_cases(df.limit(0)).count() == 0


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    chosen = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(chosen)
    rows = sorted((r for r in ROWS if r[2] is not None and r[1] is not None), key=lambda r: (r[1], r[2]))
    try:
        for part in (rows[:3], rows[3:4], rows[4:]):
            spark.createDataFrame(part, DOCUMENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(DOCUMENTS).parquet(f"{tmp_path}/in")
            running = anonymize_cases(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            assert running.awaitTermination(180) and running.exception() is None
    finally:
        spark.conf.set(chosen, before)
    show = lambda df: sorted((tuple(r) for r in df.select("case_id", "seq", "doc_id", "anonymized_text", "total_replacements").collect()), key=str)
    assert show(spark.read.parquet(f"{tmp_path}/out")) == show(anonymize_cases(spark.createDataFrame(rows, DOCUMENTS)))


@pytest.mark.parametrize("parts", [1, 7])
def test_any_partitioning_gives_the_same_numbers(spark, parts):
    rows = [("c", k, k, f"Письмо u{k % 5}@x.ru, v{k}@y.ru") for k in range(60)]
    out = anonymize_cases(spark.createDataFrame(rows, DOCUMENTS).repartition(parts), dictionaries=False)
    order = {}
    for k in range(60):
        for e in (f"u{k % 5}@x.ru", f"v{k}@y.ru"):
            order.setdefault(e, len(order) + 1)
    assert {r["doc_id"]: r["anonymized_text"] for r in out.collect()} == {k: f"Письмо [EMAIL{order[f'u{k % 5}@x.ru']}], [EMAIL{order[f'v{k}@y.ru']}]" for k in range(60)}
