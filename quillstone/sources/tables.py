"""Readers of tables whose cells are all text, and of an audit file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.months import coded_month, month_of_cell
from . import records

PLACEHOLDERS = ("", "not stated", "no source match")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell as text, empty cells as empty text; quotes
    may span lines, and many tasks read one file (see records)."""
    return placed_text_table(spark, path).drop(PLACE)


#: The column of placed_text_table that orders rows as the file does.
PLACE = "__place"


def placed_text_table(spark: SparkSession, path: str) -> DataFrame:
    """As read_text_table, with the place of each row in its file. The header stands on
    top of every file; one that says otherwise is read by position. Names that repeat
    get a number, cells beyond the header go. Of a workbook (.xlsx) the first sheet is
    read."""
    if path.lower().endswith(".xlsx"):
        from . import workbooks

        sheet = workbooks.sheet_table(workbooks.read_workbook(spark, path), workbooks.sheet_names(path)[0])
        return sheet.withColumn(PLACE, F.struct(F.lit(path).alias("file"), F.lit(0).cast("long").alias("block"), F.col("__row").cast("long").alias("nth"))).drop("__row")
    header, _ = records.csv_header(spark, path)
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"_c{i}"
        names.append(name if name not in names else f"{name}.{sum(n.split('.')[0] == name for n in names)}")
    rows = records.csv_rows(spark, path)
    # A row a file; the smallest place is its header's.
    heads = rows.groupBy("file").agg(F.min(F.struct("block", "nth")).alias("head"))
    body = rows.join(F.broadcast(heads), "file").filter(F.struct("block", "nth") != F.col("head"))
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]
    return body.select(*cells, F.struct("file", "block", "nth").alias(PLACE))


def load_panel(spark: SparkSession, path: str, key: str = "operation_number", loans_only: bool = True) -> DataFrame:
    """A panel; placeholder words are null. Legend rows have no loan key and go."""
    raw = read_text_table(spark, path)
    clean = raw.select(*[F.when(~F.trim(c).isin(*PLACEHOLDERS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return clean.filter(keys.is_loan(F.col(key))) if loans_only else clean


def _int(c: str) -> Column:
    return F.trim(c).try_cast("double").try_cast("int")


def load_transactions(spark: SparkSession, path: str, kind: str = "DISBURSEMENT") -> DataFrame:
    """operation, month, amount, counts. An unreadable amount is 0; rows without
    year, month or key go; an empty key is a key of its own."""
    t = read_text_table(spark, path)
    month = F.try_to_date(F.format_string("%04d-%02d-01", _int("Year"), _int("Month")), "yyyy-MM-dd")
    amount = F.coalesce(F.trim("Amount").try_cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    return t.select(F.col("Operation number").alias("operation"), month.alias("month"), amount.alias("amount"), (F.trim("Transaction type") == kind).alias("counts")).filter("month is not null and operation is not null")


def earliest_flow(flows: DataFrame) -> DataFrame:
    """The earliest month of any flow: operation, year, month."""
    first = F.min(F.struct(F.year("month").alias("year"), F.month("month").alias("month"))).alias("first")
    return flows.groupBy("operation").agg(first).select("operation", "first.year", "first.month")


def monthly_flows(flows: DataFrame) -> DataFrame:
    """Sums of the counted flows: operation, year, month, amount."""
    return flows.filter("counts").groupBy("operation", F.year("month").alias("year"), F.month("month").alias("month")).agg(F.sum("amount").alias("amount"))


def load_dates(spark: SparkSession, path: str) -> DataFrame:
    """Project dates: one row an operation, the first in the file."""
    t = placed_text_table(spark, path).withColumnRenamed(PLACE, "row")
    names = {"First disbursement date": "first_disbursement", "Totally disbursed date": "completed", "Current disbursement expiration date": "expiration"}
    rows = t.select(F.trim("Operation number").alias("operation"), "row", *[month_of_cell(F.col(f"`{a}`")).alias(b) for a, b in names.items()]).filter("operation <> ''")
    return rows.groupBy("operation").agg(F.min_by(F.struct(*names.values()), "row").alias("r")).select("operation", "r.*")


def load_calendar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A calendar table; where the file is missing an empty one with the same
    columns, so that a left join gives nulls."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).csv(path, header=True) if there else spark.createDataFrame([], schema)


def load_series(spark: SparkSession, path: str, name: str, date: str = "DATE", value: str | None = None) -> DataFrame:
    """A dated series; "." and other unreadable values are null."""
    t = read_text_table(spark, path)
    return t.select(F.lit(name).alias("name"), F.try_to_date(F.trim(date), "yyyy-MM-dd").alias("date"), F.trim(f"`{value or name}`").try_cast("double").alias("value"))


def find_header(cells: DataFrame, date_hint: str, value_hint: str, rows: int = 15) -> DataFrame:
    """Locate a table inside sheets. cells: sheet, row, col, text. The first sheet
    and row among the first rows with a cell that contains the date hint, and the
    first columns there that contain each hint: sheet, row, date_col, value_col."""
    head = cells.filter(F.col("row") < rows).withColumn("low", F.lower("text"))
    has = lambda hint: F.contains("low", F.lit(hint.lower()))
    found = head.groupBy("sheet", "row").agg(F.min(F.when(has(date_hint), F.col("col"))).alias("date_col"), F.min(F.when(has(value_hint), F.col("col"))).alias("value_col"))
    return found.filter("date_col is not null and value_col is not null").orderBy("sheet", "row").limit(1)


def sheet_series(cells: DataFrame, header: DataFrame, name: str) -> DataFrame:
    """The two columns below the header as a series: name, date, value."""
    h = header.select(F.col("sheet").alias("h_sheet"), F.col("row").alias("h_row"), "date_col", "value_col")
    below = cells.join(F.broadcast(h), (F.col("sheet") == F.col("h_sheet")) & (F.col("row") > F.col("h_row")))
    rows = below.groupBy("sheet", "row").agg(F.max(F.when(F.col("col") == F.col("date_col"), F.col("text"))).alias("d"), F.max(F.when(F.col("col") == F.col("value_col"), F.col("text"))).alias("v"))
    return rows.select(F.lit(name).alias("name"), F.try_to_date(F.substring("d", 1, 10), "yyyy-MM-dd").alias("date"), F.trim("v").try_cast("double").alias("value"))


#: Columns of the bulk export and what bulk_metadata calls them; some have two names.
BULK = {
    "Project Number": "operation", "Project Country": "country", "Country": "country", "Project Name": "name", "Sector": "sector", "Sub-Sector": "subsector", "Modality Code": "modality",
    "Total Cost": "total_cost", "Approval Amount": "approval_amount", "Funding Source": "funding_source", "Borrower": "borrower", "Executing Agency": "executing_agency",
    "ESG Classification": "env_class", "Lending Type": "lending_type", "Project Type": "project_type", "Status": "status", "Project Status": "status", "Approval Date": "approval_date", "Last Updated": "last_updated",
}
OPTIONAL = ("project_type", "lending_type")


def load_bulk(spark: SparkSession, path: str) -> DataFrame:
    """The bulk export with the names of bulk_metadata, and row, the file's order.
    Missing columns are null, except those whose absence lifts a condition."""
    t = placed_text_table(spark, path)
    there = {c.strip(): c for c in t.columns}
    names: dict[str, str | None] = {}
    for name, own in BULK.items():
        if name in there:
            names.setdefault(own, there[name])
    columns = []
    for own in dict.fromkeys(BULK.values()):
        c = F.nullif(F.col(f"`{names[own]}`"), F.lit("")) if own in names else F.lit(None).cast("string")
        if own in ("total_cost", "approval_amount"):
            c = F.trim(c).try_cast("decimal(20,4)")
        elif own in ("approval_date", "last_updated"):
            c = F.date_format(F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
        if own in names or own not in OPTIONAL:
            columns.append(c.alias(own))
    return t.select(*columns, F.col(PLACE).alias("row")).filter("operation is not null")


def load_approved(spark: SparkSession, path: str, thresholds: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """Denominators of a splice: operation, approved, eligible and t25, t50, ...;
    days are written 05jan2001, months 2001m1; the first row of an operation counts."""
    t = placed_text_table(spark, path).withColumnRenamed(PLACE, "row")
    columns = [F.trim("OPER_NUM").alias("operation"), F.trim("Amount_Approved").try_cast("decimal(20,4)").alias("approved"), F.try_to_date(F.initcap(F.trim("FRST_ELIG_DT")), "ddMMMyyyy").alias("eligible")]
    columns += [coded_month(F.col(f"DISB_{n}_DT")).alias(f"t{n}") for n in thresholds]
    rows = t.select(*columns, "row")
    return rows.groupBy("operation").agg(F.min_by(F.struct(*rows.columns[1:-1]), "row").alias("r")).select("operation", "r.*")


AUDIT = "map<string,struct<stats:struct<n_documents:int,n_paragraphs_total:int,n_paragraphs_relevant:int,bundle_chars:int,n_documents_failed:int,dry_run_no_key:boolean,api_call_failed:string>,fields:array<struct<field:string,value:string,status:string,citation_para:string,quote:string,source_document:string>>>>"


def load_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit file, one map of operations, one row each: operation, stats, fields.
    Many tasks read one file (see records)."""
    entries = records.json_entries(spark, path)
    return entries.select(F.explode(F.from_json("text", AUDIT)).alias("operation", "e")).select("operation", "e.stats", "e.fields")


def audit_calls(audit: DataFrame) -> DataFrame:
    """The audit's long table; calls without field or status can't be sampled."""
    rows = audit.select("operation", F.posexplode("fields").alias("call_id", "c")).select("operation", "call_id", "c.*")
    return rows.withColumn("sampleable", F.col("field").isNotNull() & F.col("status").isNotNull())


def rename(table: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed; those that are missing are added as nulls."""
    return table.select(*[(F.col(f"`{a}`") if a in table.columns else F.lit(None).cast("string")).alias(b) for a, b in names.items()])


def load_sheet_series(spark: SparkSession, path: str, name: str, date_hint: str, value_hint: str) -> DataFrame:
    """A dated series from the workbook's first sheet that has both columns."""
    from .workbooks import read_workbook

    cells = read_workbook(spark, path)
    return sheet_series(cells, find_header(cells, date_hint, value_hint), name)


def load_warehouse(spark: SparkSession, path: str) -> DataFrame:
    """The warehouse's monthly stream from a Stata file: operation, month and total, the
    sum up to that month. Rows without a key or a month go."""
    from .stata import read_stata

    t = read_stata(spark, path)
    rows = t.select(F.trim("OPER_NUM").alias("operation"), F.trunc("accounting_disb_date", "month").alias("month"), F.col("cum_disb_signed").cast("double").alias("total"))
    return rows.filter("operation <> '' and month is not null")
