"""Reports as files: DOCX with a paragraph a line, PDF with as many pages as the lines need."""

from __future__ import annotations

import io
import re
import textwrap
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.spans import column

#: Of a PDF page: lines, characters a line, place of the first line, distance of lines.
PAGE_LINES, LINE_CHARS, TOP, STEP = 50, 90, 780.0, 14.0
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
          '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
         'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
#: Characters that XML can't hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")

#: White space other than a blank.
_SPACES = re.compile(r"[^\S ]")


def docx_bytes(text: str, run: int | None = None) -> bytes:
    """A DOCX file with a paragraph for each line; in runs of so many characters, if given."""
    def runs(line: str) -> str:
        pieces = [line] if run is None else [line[i : i + run] for i in range(0, len(line), run)]
        return "".join(f'<w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r>' for p in pieces)

    body = "".join(f"<w:p>{runs(_BARRED.sub(' ', line))}</w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, said in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), said, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def pdf_file(pages: list[list[tuple[float, float, str]]]) -> bytes:
    """A PDF with the given pieces of text (x, y, text) of its pages: two-byte codes with a table to read them, packed streams."""
    letters = sorted({c for page in pages for *_, t in page for c in t})
    code = {c: n + 1 for n, c in enumerate(letters)}
    table = "".join(f"<{n:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, n in code.items())
    cmap = f"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange {len(code)} beginbfchar\n{table}endbfchar endcmap end".encode()
    kids = " ".join(f"{10 + 2 * n} 0 R" for n in range(len(pages)))
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: f"<</Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources <</Font <</F1 3 0 R>>>>>>".encode(), 3: b"<</Type /Font /Subtype /Type0 /BaseFont /A /Encoding /Identity-H /ToUnicode 4 0 R>>"}
    streams, spelt = {4: cmap}, {ord(c): f"{n:04x}" for c, n in code.items()}
    for n, page in enumerate(pages):
        objects[10 + 2 * n] = f"<</Type /Page /Parent 2 0 R /Contents {11 + 2 * n} 0 R>>".encode()
        streams[11 + 2 * n] = " ".join(f"BT /F1 10 Tf 1 0 0 1 {x} {y} Tm <{t.translate(spelt)}> Tj ET" for x, y, t in page).encode()
    for n, body in streams.items():
        packed = zlib.compress(body)
        objects[n] = b"<</Filter /FlateDecode /Length %d>>\nstream\n" % len(packed) + packed + b"\nendstream"
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"trailer <</Root 1 0 R>>\n%%EOF"


def _wrapped(line: str) -> list[str]:
    """The line as textwrap cuts it; a short one without other white space than blanks only loses those at its end."""
    if len(line) <= LINE_CHARS and not _SPACES.search(line):
        return [line.rstrip(" ")]
    return textwrap.wrap(line, LINE_CHARS) or [""]


def pdf_bytes(text: str) -> bytes:
    """A PDF file with the text's lines, long ones wrapped, on as many pages as they need."""
    lines = [part for line in text.split("\n") for part in _wrapped(line)]
    pages = [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]
    return pdf_file([[(56.0, TOP - STEP * k, line) for k, line in enumerate(page) if line] for page in pages])


def _written(write, text: str | Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else write(t) for t in texts.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(column(text))


def docx_file(text: str | Column, run: int | None = None) -> Column:
    """The bytes of a DOCX file of a text; null for a null text."""
    return _written(lambda t: docx_bytes(t, run), text)


def pdf_pages(text: str | Column) -> Column:
    """The bytes of a PDF file of a text; null for a null text."""
    return _written(pdf_bytes, text)
