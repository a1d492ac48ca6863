"""RTF: escapes, code pages, nested destinations; and texts that are written and read back."""

import pytest

import __spark_entry__ as entry
from lexweave.functions.rtf import rtf_text
from lexweave.sources import documents as docs


def cyrillic(text):
    return "".join(c if c.isascii() else "\\'" + c.encode("cp1251").hex() for c in text)


CASES = {
    "bytes of the document's page": (rf"{{\rtf1\ansi\ansicpg1251 {cyrillic('Истец Иванов')}\par {cyrillic('ООО')} 5}}", "Истец Иванов\nООО 5"),
    "bytes of the font's page": (rf"{{\rtf1\ansi\ansicpg1252{{\fonttbl{{\f0\fcharset0 Arial;}}{{\f1\fcharset204 Times;}}}}\f1 {cyrillic('Суд')}{{\f0 caf\'e9}} {cyrillic('дело')}}}", "Судcafé дело"),
    "unicode with replacements": (r"{\rtf1\uc1\u1057?\u1091?\u1076?{\uc2\u1086??x}\uc0\u1090z}", "Судоxтz"),
    "unicode replaced by a byte": (r"{\rtf1\uc1\u1057\'d1\u1091 \'f3!}", "Су!"),
    "negative unicode and pairs": (r"{\rtf1\u-10179?\u-8704? \u-3?}", "😀 �"),
    "nested destinations": (r"{\rtf1{\fonttbl{\f0 A{\*\panose 02}B;}}{\*\gen {\b x}y}{\info{\title secret}}{\pict 0a0b{\x y}}seen{\header not}{\*\unknown{\par}}!}", "seen!"),
    "signs": (r"{\rtf1 a\tab b\line c\~d\-e\_f\{g\}\\h\emdash i\rquote{\b j}}", "a\tb\nc\xa0de\u2011f{g}\\h—i’j"),
    "line ends of the file": ("{\\rtf1 a\r\nb\\par\r\nc\\\nd}", "ab\nc\nd"),
    "tables": (r"{\rtf1\trowd a\cell b\cell\row c\cell\row}", "a|b|\nc|\n"),
    "binary data": ("{\\rtf1 a{\\pict\\bin5 {}}\\x}b}", "ab"),
    "several bytes a character": (r"{\rtf1\ansi\ansicpg932 \'93\'fa\'96\'7b}", "日本"),
    "unknown page": (r"{\rtf1\ansi\ansicpg99999 caf\'e9}", "café"),
    "broken": ("{\\rtf1 a}}}b\\", "ab"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    raw, want = CASES[name]
    assert rtf_text(raw.encode("latin-1")) == want


def test_deep_groups_and_long_texts():
    assert rtf_text(b"{\\rtf1 " + b"{" * 100_000 + b"x" + b"}" * 100_000 + b"}") == "x"
    assert rtf_text(b"{\\rtf1 " + b"\\'e9" * 300_000 + b"}") == "é" * 300_000


def test_files(spark):
    rows = [("a.rtf", CASES["bytes of the document's page"][0].encode()), ("b.RTF", b"no rtf at all"), ("c.rtf", b"{\\rtf1{\\info x}}"), ("d.rtf", None)]
    files = spark.createDataFrame([(p, len(c or b""), c and bytearray(c)) for p, c in rows], "path string, length long, content binary")
    out = {r["path"]: (r["text"], r["error"]) for r in docs.extract(files).collect()}
    assert out == {"a.rtf": ("Истец Иванов\nООО 5", None), "b.RTF": ("no rtf at all", None), "c.rtf": (None, "empty"), "d.rtf": (None, "empty")}


def test_query_reads_texts_back(spark):
    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(texts) == entry.queries()["rtf_round_trip"](spark, data).where("same").count()
