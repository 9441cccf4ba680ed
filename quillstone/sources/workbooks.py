"""Workbooks (xlsx) as tables of cells, read and written without a spreadsheet library.

A workbook is a zip of XML files. The reader is a data source with a partition for each
sheet: it streams the sheet's XML, resolves shared strings and shows dates as ISO text.
The writer renders rows as XML where they are; one task then streams them, sheet by
sheet, into the zip. That task holds a batch of rows at a time, and a sheet can't have more
than 1,048,576 rows, so its work is bounded.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import stored
from .store import located, opened

CELLS = "sheet string, row int, col int, text string"
MAX_ROWS = 1_048_576
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _target(name: str) -> str:
    return name.lstrip("/") if name.startswith("/") else f"xl/{name}"


class Workbook:
    """The parts of one file: sheets in order, shared strings, styles that are dates."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): _target(r.get("Target")) for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter() if _local(s.tag) == "sheet" and s.get(_REL) in links]
        pr = next((p for p in book.iter() if _local(p.tag) == "workbookPr"), None)
        old = pr is not None and pr.get("date1904") in ("1", "true")
        self.first_day = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)
        self.names = set(self.zip.namelist())

    def shared(self) -> list[str]:
        out: list[str] = []
        if "xl/sharedStrings.xml" in self.names:
            with self.zip.open("xl/sharedStrings.xml") as file:
                for _, item in ElementTree.iterparse(file):
                    if _local(item.tag) == "si":
                        out.append(_text(item))
                        item.clear()
        return out

    def dates(self) -> set[int]:
        """The cell styles that show a date or a time."""
        if "xl/styles.xml" not in self.names:
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _local(f.tag) == "numFmt"}
        cells = next((x for x in root if _local(x.tag) == "cellXfs"), [])
        return {i for i, x in enumerate(cells) if (n := int(x.get("numFmtId", 0))) in DATE_FORMATS or is_date_format(own.get(n, ""))}

    def cells(self, target: str) -> Iterator[tuple[int, int, str]]:
        """row, col (from 0) and text of the cells that hold something, in order."""
        shared, dates = self.shared(), self.dates()
        row = -1
        with self.zip.open(target) as file:
            for event, e in ElementTree.iterparse(file, events=("start", "end")):
                tag = _local(e.tag)
                if event == "start" and tag == "row":
                    row, col = int(e.get("r", row + 2)) - 1, -1
                elif event == "end" and tag == "c":
                    col = _column(e.get("r")) if e.get("r") else col + 1
                    text = self._shown(e, shared, dates)
                    if text:
                        yield row, col, text
                elif event == "end" and tag == "row":
                    e.clear()

    def _shown(self, cell, shared: list[str], dates: set[int]) -> str:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text(cell)
        value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
        if kind == "s":
            return shared[int(value)] if value else ""
        if kind == "b":
            return {"1": "True", "0": "False"}.get(value, value)
        if kind == "n" and value and int(cell.get("s", 0)) in dates:
            return shown_date(float(value), self.first_day)
        return value


def _text(item) -> str:
    """The text of an item; readings above the words (phonetic runs) are none."""
    skip = {t for r in item.iter() if _local(r.tag) == "rPh" for t in r.iter()}
    return "".join(t.text or "" for t in item.iter() if _local(t.tag) == "t" and t not in skip)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def is_date_format(code: str) -> bool:
    """Whether a format has letters of dates outside of quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.split(";")[0])
    return bool(re.search(r"[ymdhs]", bare, re.I)) and "general" not in bare.lower()


def shown_date(serial: float, first_day: datetime) -> str:
    """Days since the first day as ISO text; the time of day where there is one. The
    calendar of 1900 has a 29 February that was none, so its first days shift by one."""
    if first_day.year == 1899 and serial < 60:
        serial += 1
    day = first_day + timedelta(seconds=round(serial * 86400))
    return day.strftime("%Y-%m-%d") if day.time() == datetime.min.time() else day.strftime("%Y-%m-%d %H:%M:%S")


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str, target: str):
        self.path, self.name, self.target = path, name, target


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        out = []
        for path in self.paths:
            with opened(path) as file:
                out += [_Sheet(path, name, target) for name, target in Workbook(file).sheets]
        return out

    def read(self, partition):
        with opened(partition.path) as file:
            for row, col, text in Workbook(file).cells(partition.target):
                yield partition.name, row, col, text


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): sheet, row, col (from 0) and text of the
    cells that hold something. Option paths: several files, separated by line ends."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split("\n") if "paths" in self.options else [self.options["path"]])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a workbook, a partition for each sheet."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


def sheet_table(cells: DataFrame, sheet: str, header_row: int = 0) -> DataFrame:
    """A sheet with a header as a table of text, and __row, a row's number in the sheet.
    Cells that hold nothing are empty text, rows that hold nothing are none; of columns
    with one name the first counts. The header is one row, collected to name the columns."""
    own = cells.filter((F.col("sheet") == sheet) & (F.col("row") >= header_row))
    head = sorted((r["col"], r["text"]) for r in own.filter(F.col("row") == header_row).collect())
    names: dict[str, int] = {}
    for col, text in head:
        names.setdefault(text, col)
    body = own.filter(F.col("row") > header_row)
    picked = [F.coalesce(F.max(F.when(F.col("col") == col, F.col("text"))), F.lit("")).alias(name) for name, col in names.items()]
    return body.groupBy(F.col("row").alias("__row")).agg(*picked)


def sheet_names(path: str) -> list[str]:
    """The sheets of a workbook in order."""
    with opened(path) as file:
        return [name for name, _ in Workbook(file).sheets]


def _cell_xml(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        if value != value or value in (float("inf"), float("-inf")):
            return ""
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def _rendered(columns: list[str], number: int):
    letters = [_letters(i) for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("__at").to_pylist()
            values = [batch.column(c).to_pylist() for c in columns]
            texts = [f'<row r="{at + 2}">' + "".join(_cell_xml(f"{a}{at + 2}", v) for a, v in zip(letters, row)) + "</row>" for at, row in zip(places, zip(*values))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["sheet", "at", "xml"])

    return run


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _parts(names: list[str]) -> dict[str, str]:
    """The small files of a workbook with these sheets."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{links}</Relationships>',
    }


def sheet_name(name: str) -> str:
    """A name that a workbook takes: 31 characters, without those it forbids."""
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"


def write_workbook(sheets: Mapping[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table, in order, each below its header. Rows
    stand in the order of the table (sort it before, if that matters); a table with more
    rows than a sheet takes fails. The file appears when it is whole."""
    names = [sheet_name(n) for n in sheets]
    rendered, headers = None, []
    for number, table in enumerate(sheets.values()):
        flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string").alias(c) if kind.startswith(("decimal", "date", "timestamp", "binary")) else F.col(f"`{c}`") for c, kind in table.dtypes]
        headers.append("".join(_cell_xml(f"{_letters(i)}1", c) for i, c in enumerate(table.columns)))
        rows = _numbered(table.select(*flat)).mapInArrow(_rendered(table.columns, number), "sheet int, at long, xml string")
        rendered = rows if rendered is None else rendered.unionByName(rows)
    if rendered is None:
        raise ValueError("a workbook has one sheet at least")
    parts = _parts(names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, there = located(path)
        part = f"{there}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(name, text)
            rows = ((s, at, x) for b in batches for s, at, x in zip(*(b.column(c).to_pylist() for c in ("sheet", "at", "xml"))))
            held = next(rows, None)
            for number, header in enumerate(headers):
                with z.open(f"xl/worksheets/sheet{number + 1}.xml", "w", force_zip64=True) as file:
                    file.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{header}</row>'.encode())
                    while held is not None and held[0] == number:
                        if held[1] + 2 > MAX_ROWS:
                            raise ValueError(f"sheet {names[number]} has more rows than a workbook takes")
                        file.write(held[2].encode())
                        held = next(rows, None)
                    file.write(b"</sheetData></worksheet>")
        store.move(part, there)
        yield pa.RecordBatch.from_pylist([{"path": there}])

    rendered.repartition(1).sortWithinPartitions("sheet", "at").mapInArrow(assemble, "path string").collect()


def _numbered(table: DataFrame) -> DataFrame:
    """The rows with their place at: counts of the partitions before, and the place in
    the own one."""
    placed = stored(table.withColumn("__id", F.monotonically_increasing_id()), needed=True)
    part, within = F.shiftright("__id", 33).alias("part"), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for p, n in counts:  # a row a partition
        bases += [F.lit(p), F.lit(total).cast("long")]
        total += n
    base = F.create_map(*bases)[F.shiftright("__id", 33)] if bases else F.lit(0).cast("long")
    return placed.withColumn("__at", within + base).drop("__id")
