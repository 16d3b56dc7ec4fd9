"""Submitted files as rows: type, hash, pages, full text.

Files are read with Spark's ``binaryFile`` source.  Plain text and DOCX need
only the standard library; PDF and images use PyMuPDF and pytesseract where
these are installed and fail with a clear message where they are not.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligora import constants as K
from eligora.functions import text as X
from eligora.schemas import PAGE

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class BackendMissing(RuntimeError):
    """A file needs a library that is not installed on the workers."""


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, content, filename, file_type, file_hash; tender and bidder are the
    two folders above a file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return describe_files(raw)


def describe_files(raw: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return raw.select("path", "content", X.file_name("path").alias("filename"), X.file_type("path").alias("file_type"),
                      F.sha2("content", 256).alias("file_hash"), F.get(parts, F.size(parts) - 3).alias("tender"),
                      F.get(parts, F.size(parts) - 2).alias("bidder"))


def _page(number: int, text: str, tables=(), confidence: float | None = None, scanned: bool = False) -> dict:
    return {"page_num": number, "text": text, "tables": [[[c for c in r] for r in t] for t in tables],
            "ocr_confidence": confidence, "is_scanned": scanned}


def _text_pages(content: bytes) -> list[dict]:
    text = content.decode("utf-8", "ignore")
    return [_page(1, text.replace("\r\n", "\n").replace("\r", "\n"))]


def _run_text(paragraph) -> str:
    marks = {_W + "t": lambda e: e.text or "", _W + "tab": lambda e: "\t",
             _W + "br": lambda e: "\n", _W + "cr": lambda e: "\n"}
    return "".join(marks[e.tag](e) for e in paragraph.iter() if e.tag in marks)


def _docx_pages(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    lines = [_run_text(p) for p in body.findall(_W + "p")]
    tables = [[["\n".join(_run_text(p) for p in cell.findall(_W + "p")).strip() for cell in row.findall(_W + "tc")]
               for row in table.findall(_W + "tr")] for table in body.findall(_W + "tbl")]
    return [_page(1, "\n".join(t for t in lines if t.strip()), tables)]


def _ocr(png: bytes) -> tuple[str, float]:
    try:
        import pytesseract
        from PIL import Image, ImageEnhance, ImageFilter
    except ImportError as e:
        raise BackendMissing("images and scanned pages need pytesseract and Pillow") from e
    image = ImageEnhance.Contrast(Image.open(io.BytesIO(png)).convert("L")).enhance(2.0)
    found = pytesseract.image_to_data(image.filter(ImageFilter.SHARPEN), output_type=pytesseract.Output.DICT)
    words = [(w, int(c)) for w, c in zip(found["text"], found["conf"]) if int(c) > 0 and w.strip()]
    mean = round(sum(c for _, c in words) / len(words), 2) if words else 0.0
    return " ".join(w for w, _ in words), float(mean)


def _pdf_pages(content: bytes) -> list[dict]:
    try:
        import fitz
    except ImportError as e:
        raise BackendMissing("PDF files need PyMuPDF") from e
    pages = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, start=1):
            text, confidence = page.get_text("text").strip(), None
            scanned = len(text) < K.SCANNED_PAGE_CHARS
            try:
                tables = [t.extract() for t in page.find_tables().tables]
            except Exception:
                tables = []
            if scanned:
                text, confidence = _ocr(page.get_pixmap(dpi=300).tobytes("png"))
            pages.append(_page(number, text, tables, confidence, scanned))
    return pages


def _image_pages(content: bytes) -> list[dict]:
    text, confidence = _ocr(content)
    return [_page(1, text, (), confidence, True)]


_READERS = {"text": _text_pages, "docx": _docx_pages, "pdf": _pdf_pages, "image": _image_pages}


def with_pages(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``pages`` and ``error``; unknown kinds give one empty page.

    A file that its reader cannot read gives one empty page and the reason, and
    does not fail the job; a missing reader library does.
    """
    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", pages array<struct<{_struct()}>>, error string"

    def read(kind: str, content: bytes) -> tuple[list[dict], str | None]:
        try:
            return (_READERS[kind](bytes(content)) if kind in _READERS else [_page(1, "")]), None
        except BackendMissing:
            raise
        except Exception as e:
            return [_page(1, "")], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [read(k, c) for k, c in zip(rows["file_type"], rows["content"])]
            yield rows.drop(columns="content").assign(pages=[p for p, _ in made], error=[e for _, e in made])
    return files.mapInPandas(run, schema)


def _struct() -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (field.split(" ", 1) for field in PAGE.split(", ")))


def page_texts(pages: Column | str) -> Column:
    """Non-empty page texts joined by blank lines."""
    texts = F.filter(F.transform(X.col(pages), lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.array_join(texts, "\n\n")


def assemble(paged: DataFrame) -> DataFrame:
    """Document rows: full text, page count, lowest OCR confidence.  Row by row."""
    return paged.withColumns({
        "full_text": page_texts("pages"), "page_count": F.size("pages"),
        "min_ocr_confidence": F.array_min(F.transform("pages", lambda p: p["ocr_confidence"]))})


def assemble_pages(pages: DataFrame, keys: list[str], block: int = 1000) -> DataFrame:
    """The same for page rows with page_num, text, ocr_confidence.

    Pages are joined block by block first, so that a document of very many
    pages is not gathered page by page in one place.
    """
    text = F.when(F.coalesce("text", F.lit("")) != "", F.struct("page_num", "text"))
    first = pages.groupBy(*keys, F.floor(F.col("page_num") / block).alias("_b")).agg(
        F.array_sort(F.collect_list(text)).alias("_p"), F.count("*").alias("_n"),
        F.min("ocr_confidence").alias("_o"))
    joined = first.select(*keys, "_n", "_o", F.when(F.size("_p") > 0, F.struct("_b", F.array_join(
        F.transform("_p", lambda p: p["text"]), "\n\n").alias("t"))).alias("_t"))
    return joined.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda b: b["t"]), "\n\n").alias("full_text"),
        F.sum("_n").alias("page_count"), F.min("_o").alias("min_ocr_confidence"))


def ingest(spark: SparkSession, path: str) -> DataFrame:
    return assemble(with_pages(read_files(spark, path)))


def confident_words(words: Column | str) -> Column:
    """OCR words, array<struct<text, conf>>, to struct<text, confidence, word_count>."""
    kept = F.filter(X.col(words), lambda w: (w["conf"] > 0) & ~X.is_blank(w["text"]))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, w: acc + w["conf"])
    mean = F.when(F.size(kept) > 0, F.round(total / F.size(kept), 2)).otherwise(F.lit(0.0))
    return F.struct(F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("text"),
                    mean.alias("confidence"), F.size(kept).alias("word_count"))
