import io
import zipfile

from pyspark.sql import functions as F

from lexweave.operators import classify, compare, evaluate
from lexweave.sources import documents as source
from lexweave.sources import store
from lexweave.streaming.jobs import session_states

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", xml)
    return out.getvalue()


def test_extract(spark):
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>Первый  абзац</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    docx = zipped(word__document=body, word__header1=f"<w:hdr {W}><w:p><w:r><w:t>шапка</w:t></w:r></w:p></w:hdr>")
    odt = zipped(content='<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p>один</text:p><text:p>  два </text:p></o>')
    rows = [("x/a.DOCX", docx), ("b.odt", odt), ("c.docx", b"broken"), ("d.txt", "Иванов".encode("cp1251")), ("e.pdf", b"%PDF"), ("f.bin", b"x"), ("g.txt", b""), ("h.txt", b"\xff\xfe\x98")]
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows] + [("big.txt", 10**9, None)], "path string, length long, content binary")
    out = {r["path"]: (r["text"], r["error"]) for r in source.extract(files).collect()}
    assert out["x/a.DOCX"] == ("[ВЕРХНИЙ КОЛОНТИТУЛ: шапка]\n\nПервый абзац\n\n| a | b |", None)
    assert out["b.odt"] == ("один\nдва", None) and out["d.txt"] == ("Иванов", None)
    assert out["c.docx"][1].startswith("unreadable") and out["e.pdf"][1] == out["f.bin"][1] == "unsupported"
    assert out["g.txt"][1] == "empty" and out["big.txt"][1] == "too_large" and out["h.txt"][1] is None


def test_archive(spark, tmp_path):
    archive = store.Archive(spark, str(tmp_path / "archive"))
    cases = spark.createDataFrame([("a.txt", "typed", 1, {"PER": ["x"]}), ("b.txt", "file", 2, {})], "filename string, input_type string, total_replacements int, entities_found map<string,array<string>>")
    archive.save(cases, ["filename"])
    archive.save(cases.limit(1), ["filename"])
    assert [r["id"] for r in archive.page(2).collect()] == [3, 2]
    assert [r["id"] for r in archive.page(2, 2).collect()] == [1]
    assert archive.mark_reviewed(2) and archive.delete(1) and not archive.delete(9)
    assert {(r["id"], r["status"]) for r in archive.cases().collect()} == {(2, "reviewed"), (3, "processed")}
    assert not archive.delete(1)
    row = archive.case(3).first()
    assert row["filename"] in ("a.txt", "b.txt") and row["status"] == "processed"


def test_audit(spark):
    events = spark.createDataFrame([("case_opened", "s", 1, {"k": "v"}), ("case_deleted", None, None, None)], "action string, subject string, case_id long, details map<string,string>")
    rows = {r["action"]: r for r in store.audit_events(events, F.lit("  ")).collect()}
    assert rows["case_opened"]["details"] == '{"k":"v"}' and rows["case_deleted"]["details"] == "{}" and rows["case_opened"]["actor"] == "local-user"


def test_compare(spark):
    law = lambda t: {"title": t, "article": None, "text": ""}
    schema = f"id long, filename string, created_at string, status string, source string, anonymized_text string, original_text string, legal_summary string, recommendations string, relevant_laws array<{classify.LAW}>, court_practice array<{classify.PRACTICE}>"
    cases = spark.createDataFrame([
        (1, "a", "", "", "", "", "one\ntwo", "s", "", [law("A"), law("B"), law("A")], []), (2, "b", "", "", "", "one\nthree", "zzz", "s", "", [law("B")], None)], schema)
    r = compare.compare_cases(spark.createDataFrame([(1, 2), (1, 9)], "left_id long, right_id long"), cases).collect()
    assert len(r) == 1 and 0 < r[0]["similarity"] < 1 and r[0]["summary_similarity"] == 1.0
    assert [x["title"] for x in r[0]["laws_only_left"]] == ["A", "A"] and r[0]["laws_only_right"] == []
    assert [tuple(h) for h in r[0]["highlights"]] == [("replace", "two", "three")]


def test_classify(spark):
    rows = spark.createDataFrame([("Увольнение РАБОТНИКА и договор",), ("аренда",), ("НДС",), (None,)], "anonymized_text string")
    assert [r["topic"] for r in classify.analyze(rows).select("topic", "anonymized_text").collect() if True].count("general") == 1
    assert rows.select(classify.topic(F.col("anonymized_text"))).first()[0] == "labor"
    a = spark.range(1).select(classify.parse_llm_analysis(F.lit('```json\n{"summary": "s", "recommendations": "r", "risks": "x"}\n```')).alias("a"), classify.parse_llm_analysis(F.lit("нет")).alias("b")).first()
    assert a["a"]["recommendations"] == "r\n\nРИСКИ: x" and a["b"]["recommendations"] == "нет" and not a["b"]["parsed"]
    assert [classify.analysis_mode(*x) for x in (("demo", None, None), ("auto", "DEMO_KEY", None), ("auto", "0123456789A", None), (None, None, "http://x"), ("?", None, ""))] == ["demo", "demo", "kp", "llm", "demo"]


def test_precision_recall(spark):
    rows = spark.createDataFrame([({"PER": ["Иванов", "Петров"], "АДРЕС": ["ул. Арбат"]}, {"PER": ["иванов "], "АДРЕС": ["г. Москва, ул. Арбат"]})], "expected map<string,array<string>>, entities_found map<string,array<string>>")
    out = {r["entity_type"]: (r["precision"], r["recall"]) for r in evaluate.precision_recall(rows).collect()}
    assert out["PER"] == (1.0, 0.5) and out["АДРЕС"] == (1.0, 1.0) and out["ORG"] == (None, None)


def test_sessions(spark):
    ops = [("a", 1, "create", 0.0, "x"), ("a", 2, "update", 3000.0, "y"), ("a", 3, "get", 3600.0, None), ("a", 4, "get", 3600.5, None), ("a", 5, "update", 3601.0, "z"), ("b", 1, "get", 1.0, None), ("b", 2, "create", 1.0, "q"), ("b", 3, "delete", 2.0, None), ("b", 4, "get", 2.0, None)]
    rows = spark.createDataFrame(ops, "session_id string, seq long, op string, at double, data string")
    out = {(r["session_id"], r["seq"]): (r["ok"], r["data"]) for r in session_states(rows).collect()}
    assert out[("a", 3)] == (True, "y") and out[("a", 4)] == (False, None) and out[("a", 5)] == (False, None)
    assert out[("b", 1)] == (False, None) and out[("b", 3)] == (True, None) and out[("b", 4)] == (False, None)
