"""Document files of operation folders: listing, kinds, and text."""

from __future__ import annotations

import io
import subprocess
import zipfile
from collections.abc import Iterator
from shutil import which
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .store import attempted, opened

MAX_BYTES = 40 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Bytes of documents that a task reads, in the mean.
TASK_BYTES = 128 << 20
LISTED = "operation string, doc_name string, path string, length long, kind string, error string"


def is_word(file) -> bool:
    """Whether a file is a zip file with a Word document in it; only the zip's directory
    is read."""
    try:
        with zipfile.ZipFile(file) as z:
            return "word/document.xml" in z.namelist()
    except (zipfile.BadZipFile, ValueError):
        return False


def kind_of(name: str, file) -> str | None:
    """The extension decides if it is known, else the content: pdf, docx or none. A file
    named .pdf whose content is none (a saved error page) is "not_pdf"."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext == "docx":
        return "docx"
    file.seek(0)
    head = bytes(file.read(4))
    if ext == "pdf" or head == b"%PDF":
        return "pdf" if head == b"%PDF" else "not_pdf"
    if head == b"PK\x03\x04":
        file.seek(0)
        return "docx" if is_word(file) else None
    return None


def _kinds(max_bytes: int, attempts: int, delay: float):
    def look(path: str, name: str) -> str | None:
        with opened(path) as file:
            file.read(1)
            return kind_of(name, file)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds, errors = [], []
            for path, name, length in zip(part["path"], part["doc_name"], part["length"]):
                kind = error = None
                try:
                    kind = attempted(lambda: look(path, name), attempts, delay)  # noqa: B023
                except OSError as e:
                    kind, error = "unreadable", str(e)
                named = name.lower().endswith((".pdf", ".docx"))
                if kind not in (None, "unreadable") and length > max_bytes or kind == "unreadable" and named and length > max_bytes:
                    kind, error = "too_large", None
                kinds.append(kind)
                errors.append(error)
            yield part.assign(kind=kinds, error=errors)

    return run


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """operation, doc_idx, doc_name, path, length, kind and error of the documents one
    folder below the root; no content. Only first bytes and zip directories are looked at.

    Documents above max_bytes, sniffed ones too, are "too_large"; files that can't be
    opened after some attempts are "unreadable", with the reason. Files that are no
    documents are left out and have no number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("operation"), F.element_at(parts, -1).alias("doc_name"), "path", "length")
    known = rows.mapInPandas(_kinds(max_bytes, attempts, delay), LISTED).filter("kind is not null")
    return stored(known.withColumn("doc_idx", F.row_number().over(Window.partitionBy("operation").orderBy("path")) - 1))


def read_contents(listed: DataFrame, attempts: int = 3, delay: float = 1.0, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The listed files with their content, where they are pdf or docx. The list is
    dealt by path to as many tasks as its bytes need, and each reads its files; contents
    are in no shuffle. A file that can't be read has no content, and "unreadable"."""
    total = listed.filter("kind in ('pdf', 'docx')").agg(F.sum("length")).first()[0] or 0
    columns = ["operation", "doc_idx", "doc_name", "path", "length", "kind", "error"]

    def whole(path: str) -> bytes:
        with opened(path) as file:
            return file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["content"] = None
                if row["kind"] in ("pdf", "docx"):
                    try:
                        row["content"] = attempted(lambda: whole(row["path"]), attempts, delay)  # noqa: B023
                    except OSError as e:
                        row["kind"], row["error"] = "unreadable", str(e)
                yield pa.RecordBatch.from_pylist([row], CONTENTS)

    dealt = listed.select(*columns).repartition(max(1, -(-total // task_bytes)), "path")
    return dealt.mapInArrow(run, "operation string, doc_idx int, doc_name string, path string, length long, kind string, error string, content binary")


CONTENTS = pa.schema([("operation", pa.string()), ("doc_idx", pa.int32()), ("doc_name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("kind", pa.string()), ("error", pa.string()), ("content", pa.binary())])


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """operation, doc_idx, doc_name, path, length, kind, error and content of the files
    one folder below the root: list_files, then read_contents."""
    return read_contents(list_files(spark, root, max_bytes))


def unreadable(files: DataFrame) -> DataFrame:
    """The preflight report: files that could not be opened or read, and why."""
    return files.filter("kind = 'unreadable'").select("operation", "doc_name", "path", "error")


def word_paragraphs(content: bytes) -> list[str]:
    """The text of each paragraph of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]


def read_word(files: DataFrame) -> DataFrame:
    """operation, doc_idx, doc_name, at, text, error of the docx files; a file that
    can't be read is one row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for op, idx, name, content in zip(part["operation"], part["doc_idx"], part["doc_name"], part["content"]):
                try:
                    rows += [(op, idx, name, i, text, None) for i, text in enumerate(word_paragraphs(content))]
                except Exception as e:  # noqa: BLE001  reported as a row
                    rows.append((op, idx, name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["operation", "doc_idx", "doc_name", "at", "text", "error"]).astype({"at": "Int64"})

    cut = files.filter("kind = 'docx'").select("operation", "doc_idx", "doc_name", "content")
    return cut.mapInPandas(run, "operation string, doc_idx int, doc_name string, at long, text string, error string")


def pdf_pages(content: bytes, readers: list | None = None) -> list[str]:
    """Page texts by the first reader that finds any; else the first error is raised.

    Readers are optional packages; none is needed to import this module."""
    first: Exception | None = None
    for reader in readers if readers is not None else installed_pdf_readers():
        try:
            pages = reader(content)
        except Exception as e:  # noqa: BLE001  the next reader may do
            first = first or e
            continue
        if any(p.strip() for p in pages):
            return pages
        first = first or ValueError("no text on any page")
    raise first or ValueError("no reader of PDF files is installed")


def installed_pdf_readers() -> list:
    from importlib.util import find_spec

    readers = []
    if find_spec("pdfplumber"):

        def plumber(content: bytes) -> list[str]:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return [p.extract_text() or "" for p in pdf.pages]

        readers.append(plumber)
    if find_spec("pypdf"):

        def pypdf_reader(content: bytes) -> list[str]:
            import pypdf

            return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]

        readers.append(pypdf_reader)
    if which("pdftotext"):
        readers.append(poppler)
    return readers


def poppler(content: bytes) -> list[str]:
    """Pages by the pdftotext program, which keeps the layout; a form feed ends a page."""
    done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, timeout=300, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip() or "pdftotext failed")
    pages = done.stdout.decode(errors="replace").split("\f")
    return pages[:-1] if not pages[-1].strip() else pages


def read_pdf(files: DataFrame, readers: list | None = None) -> DataFrame:
    """operation, doc_idx, doc_name, page, text, error of the pdf files, by the
    readers given or installed; a file that can't be read is one row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for op, idx, name, content in zip(part["operation"], part["doc_idx"], part["doc_name"], part["content"]):
                try:
                    pages = pdf_pages(content, readers)
                    rows += [(op, idx, name, i + 1, text, None) for i, text in enumerate(pages)] or [(op, idx, name, None, None, "no text found")]
                except Exception as e:  # noqa: BLE001  reported as a row
                    rows.append((op, idx, name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["operation", "doc_idx", "doc_name", "page", "text", "error"]).astype({"page": "Int64"})

    cut = files.filter("kind = 'pdf'").select("operation", "doc_idx", "doc_name", "content")
    return cut.mapInPandas(run, "operation string, doc_idx int, doc_name string, page long, text string, error string")


def project_paragraphs(files: DataFrame, readers: list | None = None) -> tuple[DataFrame, DataFrame]:
    """All documents' paragraphs, ready for project_bundle, and the notes on files
    that were skipped or could not be read."""
    from ..operators.paragraphs import segment_pages, segment_word_paragraphs

    key = F.struct("operation", "doc_idx", "doc_name").alias("doc")
    # Texts and errors are taken from one reading.
    pages, word = stored(read_pdf(files, readers), needed=True), stored(read_word(files), needed=True)
    of_pdf = segment_pages(pages.filter("error is null").select(key, F.col("page").cast("int").alias("page"), "text"), "doc")
    of_word = segment_word_paragraphs(word.filter("error is null").select(key, "at", "text"), "doc")
    paragraphs = stored(of_pdf.unionByName(of_word).select("doc.*", "pos", "para_id", "page", "text"), needed=True)
    failed = pages.filter("error is not null").select("operation", "doc_idx", "doc_name", "error").unionByName(word.filter("error is not null").select("operation", "doc_idx", "doc_name", "error"))
    megabytes = F.format_string("%.0f", F.col("length") / float(2**20))
    large = F.concat(F.lit("skipped, "), megabytes, F.lit(f" MB exceeds the {MAX_BYTES >> 20} MB parsing limit"))
    other = F.lit("skipped, not parsed for text: file is named .pdf but its content is not a PDF")
    skipped = files.filter(F.col("kind").isin("too_large", "not_pdf")).select("operation", "doc_idx", "doc_name", F.when(F.col("kind") == "too_large", large).otherwise(other).alias("why"))
    failed = failed.unionByName(files.filter("kind = 'unreadable'").select("operation", "doc_idx", "doc_name", "error"))
    every = failed.select("operation", "doc_idx", "doc_name", F.concat(F.lit("could not parse: "), F.col("error")).alias("why")).unionByName(skipped)
    notes = every.select("operation", F.col("doc_idx").alias("note_idx"), F.concat(F.lit("["), F.col("doc_name"), F.lit("] -- "), F.col("why")).alias("note"))
    return paragraphs, notes

