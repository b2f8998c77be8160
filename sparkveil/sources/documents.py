"""Sources (SRC-1 to SRC-8): folders of files and tables of texts to one frame of documents.

(doc_key, source_file, text, quality, extractor, error); a file that cannot be read is a row
with an error, never an exception.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.regexlib import strip
from ..session import attach

SUFFIXES = ("pdf", "docx", "txt")
COLUMNS = ("doc_key", "source_file", "text", "quality", "extractor", "error")


def dictionary_score(text: Column) -> Column:
    """SRC-7: share of tokens that are listed or have three letters or more; 0 without tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-ZçëÇËäÄ]{2,}"), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) | t.isin(*L.SHORT_WORDS)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(hits / F.size(tokens))


def layout_score(text: Column) -> Column:
    """SRC-8: three times the share of lines with a single sign counts against a text."""
    lines = F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    single = F.size(F.filter(lines, lambda x: F.length(strip(x)) == 1))
    return F.when(text == "", 1.0).otherwise(F.greatest(1.0 - 3.0 * single / F.size(lines), F.lit(0.0)))


def density_score(text: Column, size: Column) -> Column:
    """SRC-6."""
    return F.when(size == 0, 0.0).otherwise(F.least(F.length(strip(text)) / size / 0.3, F.lit(1.0)))


def layered_quality(text: Column, size: Column | None = None) -> Column:
    score = dictionary_score(text) * layout_score(text)
    if size is not None:
        score = score * density_score(text, size)
    return F.when(strip(text) == "", 0.0).otherwise(F.greatest(F.round(score, 4), F.lit(0.1)))


def plain_quality(text: Column) -> Column:
    return F.when(strip(text) == "", 0.0).otherwise(1.0)


def docx_text(content: bytes) -> str:
    """SRC-4: paragraphs with text, then the rows of tables, cells joined by a bar."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{ns}body")

    def text_of(node) -> str:
        out = []
        for x in node.iter():
            if x.tag == f"{ns}t":
                out.append(x.text or "")
            elif x.tag == f"{ns}tab":
                out.append("\t")
            elif x.tag in (f"{ns}br", f"{ns}cr"):
                out.append("\n")
        return "".join(out)

    parts = [t for p in body.findall(f"{ns}p") if (t := text_of(p)).strip()]
    for table in body.findall(f"{ns}tbl"):
        for row in table.findall(f"{ns}tr"):
            cells = ["\n".join(text_of(p) for p in c.findall(f"{ns}p")).strip() for c in row.findall(f"{ns}tc")]
            if cells := [c for c in cells if c]:
                parts.append(" | ".join(cells))
    return "\n".join(parts)


def pdf_text(content: bytes) -> str:
    """SRC-5, where a PDF reader is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return "\n".join(page.extract_text(layout=True) or "" for page in pdf.pages)


def _extracted(files: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """(path, length, text, error): a reader in Python, errors as rows."""
    attach(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    texts.append(read(content))
                    errors.append(None)
                except Exception as e:  # a broken file is a result
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], schema=schema)

    return files.select("path", "length", "content").mapInArrow(run, "path string, length long, text string, error string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 to SRC-5: all files of known suffixes below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("suffix").isin(*SUFFIXES))
    plain = files.filter("suffix = 'txt'").select("path", "length", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"), F.lit(None).cast("string").alias("error"))
    docx, pdf = _extracted(files.filter("suffix = 'docx'"), docx_text), _extracted(files.filter("suffix = 'pdf'"), pdf_text)

    def finished(rows: DataFrame, extractor: str, quality: Column) -> DataFrame:
        blank = F.when(strip(F.col("text")) == "", "").otherwise(F.col("text"))
        return rows.select(F.col("path").alias("doc_key"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), blank.alias("text"), quality.alias("quality"), F.lit(extractor).alias("extractor"), "error")

    return finished(plain, "text", plain_quality(F.col("text"))).unionByName(finished(docx, "docx", layered_quality(F.col("text")))).unionByName(finished(pdf, "pdf", layered_quality(F.col("text"), F.col("length"))))


def from_table(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Texts of a table as documents; null text is an empty one."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(F.col(key).cast("string").alias("doc_key"), F.concat(F.lit(source + "/"), F.col(key).cast("string")).alias("source_file"), value.alias("text"), plain_quality(value).alias("quality"), F.lit("table").alias("extractor"), F.lit(None).cast("string").alias("error"))
