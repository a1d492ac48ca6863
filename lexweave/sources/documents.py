"""Office documents as rows of text: files by suffix, errors as rows, never a failed job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.pdf import pdf_blocks
from lexweave.functions.rtf import rtf_text
from lexweave.functions.text import best_text, bound, limit_text, limited, normalize_text, rtf_to_text, strip

MAX_FILE_BYTES = 50 * 1024 * 1024
SUFFIXES = (".pdf", ".docx", ".doc", ".txt", ".rtf", ".odt")
#: Fewer characters than that on a PDF's pages: it is a scan.
MIN_PDF_CHARS = 50
#: A batch of pieces ends with the file that makes them so many.
PIECES_A_BATCH = 4_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else cp1251, else cp866, which takes any byte."""
    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for encoding in ("utf-8", "cp1251"):
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode("cp866")

    return content.map(decode)


def _paragraph(node) -> str:
    """A paragraph's runs one after another, as a word may be cut between two; tabs and breaks part words."""
    parts = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n", f"{_W}cr": lambda n: "\n", f"{_W}noBreakHyphen": lambda n: "-"}
    return " ".join("".join(parts[n.tag](n) for n in node.iter() if n.tag in parts).split())


def _table(node) -> str:
    rows = [[" ".join(p for p in map(_paragraph, cell.findall(f"{_W}p")) if p) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows if any(r))


def _part(archive: zipfile.ZipFile, name: str) -> str:
    root = ElementTree.fromstring(archive.read(name))
    parent = root.find(f"{_W}body") if root.tag.endswith("document") else root
    made = [_paragraph(c) if c.tag == f"{_W}p" else _table(c) if c.tag == f"{_W}tbl" else "" for c in (parent if parent is not None else ())]
    return "\n\n".join(x for x in made if x.strip())


def docx_text(raw: bytes) -> str:
    """A DOCX file's headers (labelled), body with tables as | cells |, and footers (labelled)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = sorted(archive.namelist())

        def labelled(prefix: str, label: str) -> list[str]:
            texts = [_part(archive, n) for n in names if n.startswith(prefix) and n.endswith(".xml")]
            return [f"[{label}: {t}]" for t in texts if t]

        body = [_part(archive, "word/document.xml")] if "word/document.xml" in names else []
        return "\n\n".join(x for x in [*labelled("word/header", "ВЕРХНИЙ КОЛОНТИТУЛ"), *body, *labelled("word/footer", "НИЖНИЙ КОЛОНТИТУЛ")] if x.strip())


def odt_text(raw: bytes) -> str:
    """An ODT file's paragraphs, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ElementTree.fromstring(archive.read("content.xml"))
    lines = (" ".join("".join(p.itertext()).split()) for p in root.iter(f"{_TEXT}p"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def zipped_text(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    """Text of DOCX and ODT files, or why there is none; neither for null."""
    out = []
    for raw, kind in zip(content, suffix):
        if raw is None:
            out.append((None, None))
            continue
        try:
            out.append((docx_text(raw) if kind == ".docx" else odt_text(raw), None))
        except Exception as e:  # a broken file is a row of its own
            out.append((None, f"unreadable: {type(e).__name__}"))
    return pd.DataFrame(out, columns=["text", "error"])


@F.pandas_udf(T.StringType())
def rtf_content(content: pd.Series) -> pd.Series:
    """Text of RTF files; bytes that don't begin as one does give null."""
    return content.map(lambda raw: rtf_text(raw) if raw is not None and raw.lstrip()[:5] == b"{\\rtf" else None)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, length, content) of the files under a path; larger files come without content, which isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    held = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    return held.union(files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary")))


def stream_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, files_a_batch: int = 1_000) -> DataFrame:
    """(path, length, content) of the files that arrive under a path, as a stream; larger ones come without content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def pdf_pieces(files: DataFrame) -> DataFrame:
    """(path, digest, page, n, x, y, end, size, text, error) of PDF files (path, content): a row a piece of text, or one with an error or without text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), _PIECES)], schema=pa.schema(_PIECES))

        for batch in batches:
            for path, digest, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "digest", "content"))):
                rows, error = [], None
                try:
                    rows = [(path, digest, page, n, *b, None) for page, n, b in pdf_blocks(raw or b"")]
                except Exception as e:  # a broken file is a row of its own
                    error = f"unreadable: {e if isinstance(e, ValueError) else type(e).__name__}"
                held += rows or [(path, digest, *[None] * 7, error)]
                if len(held) >= PIECES_A_BATCH:
                    yield made()
                    held = []
        if held:
            yield made()

    schema = "path string, digest long, page int, n int, x double, y double, end double, size double, text string, error string"
    return files.select("path", F.xxhash64("content").alias("digest"), "content").mapInArrow(run, schema)


_PIECES = [("path", pa.string()), ("digest", pa.int64()), ("page", pa.int32()), ("n", pa.int32()), *((c, pa.float64()) for c in ("x", "y", "end", "size")), ("text", pa.string()), ("error", pa.string())]


def pdf_text(files: DataFrame) -> DataFrame:
    """(path, text, error) of PDF files (path, content): the better of the text as it is drawn and the text in lines by position.

    A piece begins a line if it stands half a letter or more below or above the one before; a gap between two is a blank.
    Pages stand apart by an empty line. Pieces of a page are brought together, not those of a file; then a file's pages.
    Rows of equal path and content are one file; a null path is a path like others.
    """
    page = ["path", "digest", "page"]
    # Dealt out once, to tasks whose number Spark doesn't lower for their few bytes.
    spark = files.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pdf_pieces(files).repartition(tasks, *page).dropDuplicates([*page, "n"])
    drawn = Window.partitionBy(*page).orderBy("n")
    down = Window.partitionBy(*page).orderBy(F.desc("y"), "x", "n")
    apart = lambda w: F.abs(F.lag("y").over(w) - F.col("y")) > 0.5 * F.greatest("size", F.lag("size").over(w))
    steps = pieces.withColumns({"new": F.coalesce(apart(drawn), F.lit(False)), "gap": F.col("x") - F.lag("end").over(drawn), "before": F.lag("text").over(drawn), "falls": F.coalesce(apart(down), F.lit(False)).cast("int")})
    lines = steps.withColumn("line", F.sum("falls").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    across = Window.partitionBy(*page, "line").orderBy("x", "n")
    wide = lambda gap, before: (gap > 0.15 * F.col("size")) & ~F.endswith(before, F.lit(" ")) & ~F.startswith(F.col("text"), F.lit(" "))
    said = lines.withColumns({
        "as_drawn": F.concat(F.when(F.col("new"), "\n").when(wide(F.col("gap"), F.col("before")), " ").otherwise(""), "text"),
        "as_placed": F.concat(F.when(F.lag("text").over(across).isNull(), F.when(F.col("line") > 0, "\n").otherwise("")).when(
            wide(F.col("x") - F.lag("end").over(across), F.lag("text").over(across)), " ").otherwise(""), "text")})
    gathered = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, c))), lambda z: z[c]), "").alias(c)
    pages = said.groupBy(*page).agg(gathered(["n"], "as_drawn"), gathered(["line", "x", "n"], "as_placed"), F.max("error").alias("error"))
    whole = lambda c: F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("page", c))), lambda z: z[c]), lambda t: F.trim(t) != ""), "\n\n").alias(c)
    texts = pages.groupBy("path", "digest").agg(whole("as_drawn"), whole("as_placed"), F.max("error").alias("error"))
    same = F.when(strip(F.col("as_placed")) != "", F.col("as_placed"))
    return texts.select("path", F.when(F.col("as_placed") == F.col("as_drawn"), same).otherwise(best_text(F.array("as_placed", "as_drawn"))).alias("text"), "error")


def extract_pdf(files: DataFrame) -> DataFrame:
    """(path, text, error) of PDF files (path, content), whatever their names; texts and errors are extract()'s."""
    def judged(t: Column) -> Column:
        return F.struct(F.when(F.col("error").isNull() & (F.length(t) >= MIN_PDF_CHARS), limited(t)).alias("text"), F.coalesce("error", F.when(F.length(t) < MIN_PDF_CHARS, "empty")).alias("error"))

    return pdf_text(files).select("path", bound(normalize_text(F.col("text")), judged).alias("r")).select("path", "r.text", "r.error")


def extract_all(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """extract() of files (path, length, content) with the texts of PDF files read here, once; paths must differ."""
    kind = suffix_of(F.col("path"))
    here = F.coalesce((kind == ".pdf") & (F.col("length") <= max_bytes), F.lit(False))
    rest = files.where(~here).withColumn("_lexweave_pdf", F.when(kind == ".pdf", F.lit("")))
    return extract_pdf(files.where(here)).union(extract(rest, pdf_text="_lexweave_pdf", max_bytes=max_bytes))


def extract(files: DataFrame, pdf_text: str | None = None, doc_text: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, text, error) for files (path, length, content). error: too_large, unsupported, unreadable..., empty, or null.

    PDF and DOC need an extractor outside: name the columns its texts are in, else these files are unsupported.
    """
    kind = suffix_of(F.col("path"))
    typed = files.withColumn("_kind", kind)
    # A function of Python's is worked out for every row, so it gets the content of its own kinds alone.
    of = lambda *kinds: F.when(F.col("_kind").isin(*kinds), F.col("content"))
    zipped = F.when(F.col("_kind").isin(".docx", ".odt") & F.col("content").isNotNull(), zipped_text(of(".docx", ".odt"), "_kind"))
    plain = F.when(F.col("_kind").isin(".txt", ".rtf"), decode_text(of(".txt", ".rtf")))
    rtf = F.when(F.col("_kind") == ".rtf", F.coalesce(rtf_content(of(".rtf")), rtf_to_text(F.col("_plain"))))
    read = typed.withColumns({"_zip": zipped, "_plain": plain}).withColumn("_rtf", rtf)
    other = lambda name: F.col(name) if name else F.lit(None).cast("string")
    raw = (
        F.when(F.col("_kind") == ".txt", F.col("_plain")).when(F.col("_kind") == ".rtf", F.col("_rtf")).when(F.col("_kind").isin(".docx", ".odt"), F.col("_zip.text"))
        .when(F.col("_kind") == ".pdf", other(pdf_text)).when(F.col("_kind") == ".doc", other(doc_text))
    )
    least = F.when(F.col("_kind") == ".pdf", MIN_PDF_CHARS).otherwise(1)
    error = (
        F.when(F.col("length") > max_bytes, "too_large").when(~F.col("_kind").isin(*SUFFIXES), "unsupported")
        .when(F.col("_kind").isin(".pdf", ".doc") & F.col("_raw").isNull(), "unsupported").when(F.col("_zip.error").isNotNull(), F.col("_zip.error"))
        .when(F.length(normalize_text(F.col("_raw"))) < least, "empty")
    )
    done = read.withColumn("_raw", raw).withColumn("error", error)
    return done.select("path", F.when(F.col("error").isNull(), limit_text(F.col("_raw"))).alias("text"), "error")


def order_blocks(blocks: Column) -> Column:
    """A page's text from blocks (x, y, text), by x, then y, to one digit."""
    placed = F.transform(F.filter(blocks, lambda b: F.trim(b["text"]) != ""), lambda b, i: F.struct(F.round(b["x"], 1).alias("x"), F.round(b["y"], 1).alias("y"), i.alias("i"), F.trim(b["text"]).alias("text")))
    return F.array_join(F.transform(F.array_sort(placed), lambda b: b["text"]), "\n")
