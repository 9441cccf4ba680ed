"""Project pages: HTML to text, labelled values, and listed documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, stripped

LABELS = {"country": "Country", "approval_date": "Approval Date", "project_status": "Project Status", "lending_instrument": "Lending Instrument"}
URL_LINE = r"^https?://\S+$"
BREAKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "header", "footer", "nav", "title", "dt", "dd"}
SILENT = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def page_text(html: str | None) -> str:
    """Visible text, one line a block, without images, scripts and blank lines."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _texts(htmls: pa.Array) -> pa.Array:
    return pa.array((page_text(html.as_py()) for html in htmls), pa.string())


def html_to_text(c: Column) -> Column:
    return F.arrow_udf(_texts, "string")(c)


def _lines(text: str) -> Column:
    """The lines of a text that are not blank, each with its place among all of them."""
    split = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.filter(F.transform(split, lambda line, at: F.struct(at.alias("at"), stripped(line).alias("line"))), lambda x: x["line"] != "")


def _labelled(labels: dict[str, str]) -> list[Column]:
    line = F.col("__lines.line")
    place = {name: F.array_position(line, F.lit(label)).cast("int") for name, label in labels.items()}
    return [F.when(at > 0, F.coalesce(F.get(line, at), F.lit(""))).otherwise("").alias(name) for name, at in place.items()]


def _listed(category: str, url_line: str) -> Column:
    lines, n = F.col("__lines"), F.size("__lines")
    line = lambda i, k: F.get(lines, i + k)["line"]
    starts = F.when(n > 4, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    places = F.filter(starts, lambda i: line(i, 0).rlike(url_line) & (F.lower(line(i, 1)) == category))
    return F.transform(places, lambda i: F.struct(F.get(lines, i)["at"].alias("at"), line(i, 0).alias("url"), line(i, 2).alias("filename"), line(i, 3).alias("date"), line(i, 4).alias("language")))


def labelled_values(pages: DataFrame, key: str = "page_id", text: str = "text", labels: dict[str, str] = LABELS) -> DataFrame:
    """The line after the first line that is exactly a label; '' without one. A row a page."""
    return pages.select(key, _lines(text).alias("__lines")).select(key, *_labelled(labels))


def listed_documents(pages: DataFrame, key: str = "page_id", text: str = "text", category: str = "loan proposal", url_line: str = URL_LINE) -> DataFrame:
    """Documents listed as five lines: url, category, file name, date, language."""
    return pages.select(key, _lines(text).alias("__lines")).select(key, F.inline(_listed(category, url_line)))


def page_fields(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """One row a page: the labelled values and its documents in order. A page is a row,
    so its lines are looked at where it is read, and its text is made once."""
    rows = pages.select(key, _lines(text).alias("__lines")).select(key, *_labelled(LABELS), _listed("loan proposal", URL_LINE).alias("docs"))
    docs = F.transform("docs", lambda d: F.struct(d["url"].alias("url"), d["filename"].alias("filename"), d["date"].alias("date"), d["language"].alias("language")))
    return rows.withColumn("docs", F.when(F.size("docs") > 0, docs))


def not_yet_stored(wanted: DataFrame, files: DataFrame, key: str = "operation") -> DataFrame:
    """Operations without a stored file that holds anything. files: key, length."""
    return wanted.join(files.filter("length > 0").select(key).distinct(), key, "left_anti")


def safe_name(names: Iterator[pd.Series], limit: int = 150) -> Iterator[pd.Series]:
    """File names cut to a byte limit, keeping a short extension."""

    def cut(name: str | None) -> str | None:
        if name is None:
            return None
        stem, dot, ext = name.rpartition(".")
        if not dot or len(ext) + 1 > 5:
            stem, ext = name, ""
        else:
            ext = "." + ext
        return stem.encode()[: limit - len(ext.encode())].decode(errors="ignore") + ext

    for part in names:
        yield part.map(cut)


def _safe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from safe_name(parts)


def safe_file_name(c: Column) -> Column:
    return F.pandas_udf(_safe, "string")(c)


def in_scope(folders: DataFrame, wanted: DataFrame, key: str = "operation", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The folders that a list names, the first ones by name if there is a limit; and
    the names of the list without a folder."""
    kept = folders.join(wanted.select(key).distinct(), key, "left_semi")
    unknown = wanted.select(key).distinct().join(folders.select(key).distinct(), key, "left_anti")
    return (kept if limit is None else kept.orderBy(key).limit(limit)), unknown


def wanted_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keys of a list file: trimmed, without blanks and # lines, each once."""
    key = stripped(F.col(column))
    return lines.select(key.alias("operation")).filter((F.col("operation") != "") & ~F.col("operation").startswith("#")).distinct()
