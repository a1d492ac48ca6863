"""PDF: files written here and read back, by what a PDF may use; broken and odd ones."""

import zlib

import pytest
from pyspark.sql import functions as F

from lexweave.functions.pdf import Parser, pdf_blocks
from lexweave.sources import documents as docs
from lexweave.sources.exports import pdf_bytes, pdf_file


def simple(content, font=b"<</Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding>>", more=b"", filtered=b"", head=b""):
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1>>", b"<</Type /Page /Contents [4 0 R] /Resources <</Font <</F 5 0 R>> /XObject <</X 6 0 R>>>>>>",
               b"<<%s /Length %d>> stream\r\n%s\nendstream" % (filtered, len(content), content), font, more or b"null"]
    return b"%PDF-1.4\n" + head + b"".join(b"%d 0 obj %s endobj\n" % (n + 1, o) for n, o in enumerate(objects))


def texts(raw):
    return [b.text for *_, b in pdf_blocks(raw)]


def test_values():
    parser = Parser(rb"<</A#20B [1 -2.5 (a\(b\)\101\n(c)) <4a4B5>] /C 7 0 R /D true % note" + b"\n/E null>> word")
    assert parser.value() == {"A B": [1, -2.5, b"a(b)A\n(c)", b"JKP"], "C": (7,), "D": True, "E": None} and parser.value() == "word" and parser.value() is None
    assert Parser(b"[[[[<<").value() is not None and Parser(b"(never ends").value() == b"never ends" and Parser(b")").value() == ")"
    assert Parser(b"[" * 10_000).value() is not None


CASES = {
    "operators": (simple(rb"BT /F 10 Tf 12 TL 72 700 Td (One) Tj T* (Two) Tj (Three) ' 1 2 (Four) "  b'" ET'), ["One", "Two", "Three", "Four"]),
    "kerning": (simple(rb"BT /F 10 Tf [(W) 120 (or) -300 (d)] TJ ET"), ["W", "or", "d"]),
    "codes of the page": (simple(b"BT /F 10 Tf (caf\xe9 \x80) Tj ET"), ["café €"]),
    "named glyphs": (simple(b"BT /F 10 Tf (\x01\x02\x03\x04 x) Tj ET", b"<</Subtype /Type1 /Encoding <</Differences [1 /afii10017 /uni0431 /afii10023 /hyphen]>>>>"), ["АбЁ- x"]),
    "packed": (simple(zlib.compress(b"BT /F 10 Tf (packed) Tj ET"), filtered=b"/Filter /FlateDecode"), ["packed"]),
    "cut off": (simple(zlib.compress(b"BT /F 10 Tf (all that is there) Tj ET" + bytes(range(256)) * 20)[:60], filtered=b"/Filter [/FlateDecode]"), ["all that is there"]),
    "hexadecimal": (simple(b"4254202f46203130205466202848692920546a204554>", filtered=b"/Filter /AHx"), ["Hi"]),
    "forms": (simple(b"q 1 0 0 1 5 5 cm /X Do Q", more=b"<</Type /XObject /Subtype /Form /Length 29>> stream\nBT /F 10 Tf (in form) Tj ET  \nendstream"), ["in form"]),
    "images": (simple(b"BI /W 1 ID \x00(no) Tj\x00 EI BT /F 10 Tf (after) Tj ET"), ["after"]),
    "unknown filter": (simple(b"(x) Tj", filtered=b"/Filter /DCTDecode"), []),
    "newer objects count": (simple(b"BT (old) Tj ET") + b"4 0 obj <<>> stream\nBT (new) Tj ET\nendstream endobj", ["new"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    raw, want = CASES[name]
    assert texts(raw) == want


def test_object_streams_and_predictors():
    inner = b"1 0 2 31 3 62 "
    values = b"<</Type /Catalog /Pages 2 0 R>>" + b" <</Type /Pages /Kids [3 0 R]>>".ljust(31) + b" <</Type /Page /Contents 9 0 R>>"
    body = inner + values
    row = -(-len(body) // 8) * 8
    padded = body.ljust(row)
    png = b"".join(b"\x02" + bytes((c - (padded[i - 8 + k] if i else 0)) & 255 for k, c in enumerate(padded[i : i + 8])) for i in range(0, row, 8))
    packed = zlib.compress(png)
    raw = b"%%PDF-1.5\n8 0 obj <</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 8>> /Length %d>> stream\n%s\nendstream endobj\n9 0 obj <<>> stream\nBT (deep) Tj ET\nendstream endobj" % (len(inner), len(packed), packed)
    assert texts(raw) == ["deep"]


def test_errors():
    for raw in (b"", b"text", b"%PDF-1.4 trailer <</Encrypt 5 0 R>>"):
        with pytest.raises(ValueError):
            list(pdf_blocks(raw))
    assert list(pdf_blocks(b"%PDF-1.4 nothing")) == []


def test_files(spark):
    page = [(300.0, 700.0, "рядом"), (72.0, 650.0, "Ниже"), (72.0, 701.0, "Выше и"), (102.0, 650.0, "стоящее слово — и ещё немного текста для порядка")]
    rows = [("a.pdf", pdf_file([page, [(72.0, 700.0, "Вторая страница")], [(1.0, 1.0, " ")]])), ("b.pdf", b"no pdf"), ("c.pdf", b"%PDF-1.4"), ("d.pdf", None), ("a2.PDF", pdf_file([[(1.0, 1.0, "мало")]])), ("e.txt", "Просто текст".encode())]
    files = spark.createDataFrame([(p, len(c or b""), c and bytearray(c)) for p, c in rows], "path string, length long, content binary").repartition(3)
    out = {r["path"]: (r["text"], r["error"]) for r in docs.extract_all(files).collect()}
    assert out == {
        "a.pdf": ("Выше и рядом\nНиже стоящее слово — и ещё немного текста для порядка\n\nВторая страница", None), "b.pdf": (None, "unreadable: no PDF"), "c.pdf": (None, "empty"), "d.pdf": (None, "unreadable: no PDF"),
        "a2.PDF": (None, "empty"), "e.txt": ("Просто текст", None)}
    twice = docs.pdf_text(files.where("path = 'a.pdf'").union(files.where("path = 'a.pdf'"))).select(F.length("text")).collect()
    assert len(twice) == 1 and docs.pdf_text(files.limit(0)).count() == 0


def test_long_reports_take_several_pages():
    text = "\n".join(f"Строка {k} отчёта" for k in range(120)) + "\n" + "слово " * 60
    pieces = list(pdf_blocks(pdf_bytes(text)))
    assert {page for page, *_ in pieces} == {0, 1, 2} and " ".join(b.text for *_, b in pieces).split() == text.split()
    assert list(pdf_blocks(pdf_bytes(""))) == []
