"""Resume files: binaryFile rows to text by extension. PDF needs a PDF library; without one it is an error row."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def fits(length: Column, max_mb: int = 5) -> Column:
    return length <= F.lit(max_mb * 1024 * 1024)


def decoded_text(content: Column) -> Column:
    """UTF-8, else Latin-1; without white space at the ends."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def docx_text(content: bytes) -> str:
    """The paragraphs outside tables, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")).strip()


def _plumbed(content: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(filter(None, (page.extract_text() for page in pdf.pages)))


def _read(content: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(filter(None, (page.extract_text() for page in PdfReader(io.BytesIO(content)).pages)))


PDF_READERS = [_plumbed, _read]


def pdf_text(content: bytes) -> str:
    """The text that the first reader gives which is there, doesn't fail and finds any."""
    failed = None
    for reader in PDF_READERS:
        try:
            if text := reader(content).strip():
                return text
        except Exception as error:  # the next reader may do better
            failed = error
    if failed:
        raise failed
    return ""


def _extracted(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
    out = []
    for kind, content in zip(kinds, contents):
        try:
            out.append(({"docx": docx_text, "pdf": pdf_text}[kind](bytes(content)), None))
        except Exception as error:  # a broken file is a row, not a failed job
            out.append((None, f"{kind}: {type(error).__name__}"))
    return pd.DataFrame(out, columns=["text", "error"])


def extracted(files: DataFrame, max_mb: int = 5) -> DataFrame:
    """files (path, length, content) with text and error."""
    kind, none = extension(F.col("path")), F.lit(None).cast("string")
    small, run = files.where(fits(F.col("length"), max_mb)), F.pandas_udf(_extracted, "text string, error string")
    plain = small.where(kind == "txt").select("path", decoded_text(F.col("content")).alias("text"), none.alias("error"))
    rich = small.where(kind.isin("docx", "pdf")).select("path", run(kind, F.col("content")).alias("x")).select("path", "x.text", "x.error")
    other = small.where(~kind.isin("txt", "docx", "pdf")).select("path", none.alias("text"), F.lit("unsupported").alias("error"))
    large = files.where(~fits(F.col("length"), max_mb)).select("path", none.alias("text"), F.lit("too large").alias("error"))
    every = plain.unionByName(rich).unionByName(large).unionByName(other)
    return every.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("no text"))))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    return extracted(spark.read.format("binaryFile").load(path))
