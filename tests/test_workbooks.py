"""Workbooks and Stata files: hand-made ones read by several tasks, and written ones read back."""

import struct
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillstone.sources import stata, tables, workbooks as wb

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def hand_made(path, old=False):
    """Two sheets in the other order of their files; shared strings, dates, formulas."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="{int(old)}"/><sheets><sheet name="notes" sheetId="1" r:id="rId2"/><sheet name="data &amp; more" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Ref date</t></si><si><r><t>GSCPI </t></r><r><t>value</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Date of issue</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/a.xml", f"""<worksheet {MAIN}><sheetData>
<row r="4"><c r="B4" t="s"><v>0</v></c><c r="C4" t="s"><v>1</v></c><c r="AA4" t="b"><v>1</v></c></row>
<row r="5"><c r="B5" s="1"><v>36556</v></c><c r="C5" s="3"><v>0.5</v></c></row>
<row r="7"><c r="B7" s="2"><v>36585.5</v></c><c r="C7" t="str"><f>A1</f><v>n/a</v></c><c r="D7"/></row></sheetData></worksheet>""")  # fmt: skip


def test_reader(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    hand_made(path)
    cells = wb.read_workbook(spark, path)
    assert cells.rdd.getNumPartitions() == 2  # one a sheet
    got = {(r["sheet"], r["row"], r["col"]): r["text"] for r in cells.collect()}
    more = "data & more"
    assert got == {("notes", 0, 0): "Date of issue", (more, 3, 1): "Ref date", (more, 3, 2): "GSCPI value", (more, 3, 26): "True", (more, 4, 1): "2000-01-31", (more, 4, 2): "0.5", (more, 6, 1): "2000-02-29 12:00:00", (more, 6, 2): "n/a"}
    series = tables.load_sheet_series(spark, path, "gscpi", "date", "gscpi").orderBy("date").collect()
    assert [(str(r["date"]), r["value"]) for r in series] == [("2000-01-31", 0.5), ("2000-02-29", None)]
    hand_made(path, old=True)
    assert wb.read_workbook(spark, path).filter("row = 4 and col = 1").first()["text"] == "2004-02-01"


def test_formats_and_days():
    assert [wb.is_date_format(c) for c in ("yyyy-mm-dd", "General", '0.00 "days"', "[Red]0", "h:mm", "#,##0_d", "[$-409]d/m/yy")] == [True, False, False, False, True, False, True]
    from datetime import datetime

    first = datetime(1899, 12, 30)
    assert [wb.shown_date(x, first) for x in (1, 59, 61, 36526.25)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2000-01-01 06:00:00"]


def test_four_sheets_written_and_read_back(spark, tmp_path):
    rows = [(i, f"<t&ext> {i} \n é{chr(1)}", i / 7, i % 2 == 0, date(2000, 1, 1 + i % 28), [i, i + 1], None) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, `te xt` string, x double, flag boolean, day date, list array<int>, none string").repartitionByRange(4, "id").sortWithinPartitions("id")
    path = str(tmp_path / "out.xlsx")
    sheets = {"panel": table, "empty": table.limit(0), "a/b:c" + "x" * 40: spark.range(3).toDF("k"), "counts": table.groupBy("flag").agg(F.count("*").alias("n"))}
    wb.write_workbook(sheets, path)
    cells = wb.read_workbook(spark, path).collect()
    assert list(dict.fromkeys(c["sheet"] for c in sorted(cells, key=lambda c: list(map(wb.sheet_name, sheets)).index(c["sheet"])))) == list(map(wb.sheet_name, sheets))
    got = {(c["row"], c["col"]): c["text"] for c in cells if c["sheet"] == "panel"}
    assert [got[0, i] for i in range(7)] == table.columns
    for i, text, x, flag, day, listed, _ in rows:
        assert [got.get((i + 1, c)) for c in range(7)] == [str(i), text.replace(chr(1), ""), repr(x), str(flag), str(day), f"[{i},{i + 1}]", None]
    assert sum(c["sheet"] == "empty" for c in cells) == 7
    back = wb.sheet_table(wb.read_workbook(spark, path), "panel")
    assert back.count() == 500 and back.filter("__row = 7").first()["id"] == "6"
    with pytest.raises(ValueError):
        wb.write_workbook({}, path)


def test_bulk_list_from_a_workbook(spark, tmp_path):
    """The first sheet as a table of text, with the file's order."""
    path = str(tmp_path / "bulk.xlsx")
    rows = [("AR-L1234", "Peru", "KIF-x", 2500000.0), ("AR-L1234", "Chile", "ORC-y", 5000000.0), (None, "Peru", None, None)]
    bulk = spark.createDataFrame(rows, "`Project Number` string, Country string, `Funding Source` string, `Approval Amount` double").coalesce(1)
    wb.write_workbook({"list": bulk, "other": spark.range(2)}, path)
    got = tables.load_bulk(spark, path).orderBy("row").collect()
    assert [(r["operation"], r["country"], r["funding_source"], int(r["approval_amount"])) for r in got] == [("AR-L1234", "Peru", "KIF-x", 2500000), ("AR-L1234", "Chile", "ORC-y", 5000000)]


def stata_file(path, rows, release=118, order="<"):
    """A file with every type of number, made by hand."""
    wide = release >= 118
    name, form = (129, 57) if wide else (33, 49)
    names = ["OPER_NUM", "accounting_disb_date", "cum", "m", "n", "b", "f", "at"]
    formats = ["%9s", "%td", "%10.0g", "%tm", "%8.0g", "%8.0g", "%9.0g", "%tc"]
    types = [8, 65528, 65526, 65529, 65528, 65530, 65527, 65526]
    pad = lambda text, size: text.encode().ljust(size, b"\0")
    sections = [("variable_types", b"".join(struct.pack(order + "H", t) for t in types)), ("varnames", b"".join(pad(n, name) for n in names)), ("sortlist", b"\0\0" * 9), ("formats", b"".join(pad(f, form) for f in formats))]
    sections += [("value_label_names", b""), ("variable_labels", b""), ("characteristics", b"")]
    record = struct.Struct(order + "8sidhibfd")
    sections += [("data", b"".join(record.pack(*[x.encode() if isinstance(x, str) else x for x in r]) for r in rows)), ("strls", b""), ("value_labels", b"")]
    head = f"<stata_dta><header><release>{release}</release><byteorder>{'LSF' if order == '<' else 'MSF'}</byteorder><K>".encode() + struct.pack(order + "H", 8) + b"</K><N>" + struct.pack(order + ("Q" if wide else "I"), len(rows)) + b"</N></header>"
    places, at = [0, len(head)], len(head) + 5 + 112 + 6
    for tag, body in sections:
        places.append(at)
        at += len(body) + 2 * len(tag) + 5
    places += [at, at + 12]
    with open(path, "wb") as f:
        f.write(head + b"<map>" + struct.pack(f"{order}14Q", *places) + b"</map>")
        for tag, body in sections:
            f.write(f"<{tag}>".encode() + body + f"</{tag}>".encode())
        f.write(b"</stata_dta>")


@pytest.mark.parametrize("release,order", [(117, "<"), (118, "<"), (118, ">")])
def test_stata_by_ranges_of_rows(spark, tmp_path, release, order):
    path = str(tmp_path / "a.dta")
    rows = [(f"AR{i:04d}", 14610 + i, i / 4, 480 + i % 24, i, i % 100, 0.5, 1000.0 * i) for i in range(2000)]
    rows[7] = ("é" if release >= 118 else "e", 2147483621, 8.99e307, 32741, 2147483647, 101, 1.8e38, 8.99e307)
    stata_file(path, rows, release, order)
    table = stata.read_stata(spark, path, range_bytes=4000)
    assert table.rdd.getNumPartitions() > 15
    assert dict(table.dtypes) == {"OPER_NUM": "string", "accounting_disb_date": "date", "cum": "double", "m": "date", "n": "int", "b": "tinyint", "f": "float", "at": "timestamp_ntz"}
    got = {r["OPER_NUM"]: r for r in table.collect()}
    assert len(got) == 2000 and got["é" if release >= 118 else "e"][1:] == (None,) * 7
    r = got["AR0030"]
    assert tuple(r)[1:] == (date(2000, 1, 31), 7.5, date(2000, 7, 1), 30, 30, 0.5, datetime(1960, 1, 1, 0, 0, 30))


def test_stata_written_by_pandas(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "p.dta")
    frame = pd.DataFrame({"OPER_NUM": ["A", "A", "B", ""], "accounting_disb_date": pd.to_datetime(["2000-01-15", "2000-02-15", "2001-03-15", None]), "cum_disb_signed": [1.5, 2.5, None, 4.0]})
    frame.to_stata(path, write_index=False, version=118, convert_dates={"accounting_disb_date": "td"})
    back = pd.read_stata(path)
    got = [tuple(r) for r in stata.read_stata(spark, path).collect()]
    assert got == [(o, None if pd.isna(d) else d.date(), None if pd.isna(c) else c) for o, d, c in back.itertuples(index=False)]
    stream = tables.load_warehouse(spark, path).collect()
    assert {(r["operation"], str(r["month"]), r["total"]) for r in stream} == {("A", "2000-01-01", 1.5), ("A", "2000-02-01", 2.5), ("B", "2001-03-01", None)}
