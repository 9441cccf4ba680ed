"""Writers of results, and the frames of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import DESCRIPTIONS, FIELDS
from .commits import KeyLog

LOG_COLUMNS = ("operation_number", "eligible", "n_docs", "country", "lending_instrument", "project_status", "approval_date", "note")
REVIEW_COLUMNS = ("hand_coded_value", "agrees", "reviewer_note")


def append_new(results: DataFrame, path: str, key: str, batch: int | None = None) -> int:
    """Append the rows whose key the table doesn't hold yet; how many there were. A run
    that is repeated after a failure adds nothing twice, and no earlier result is
    rewritten. The keys are looked up in a log (see commits)."""
    return KeyLog(results.sparkSession, path, key).append(results, batch)


def write_csv(table: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables of report size. Nested columns are JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, kind in table.dtypes]
    table.select(*flat).repartition(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_log(log: DataFrame, path: str) -> None:
    """The harvest log: its eight columns in order; missing ones are empty."""
    write_csv(log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in LOG_COLUMNS]), path)


def dump_document(paragraphs: DataFrame, bundle: DataFrame, folder: str) -> None:
    """A document's paragraphs as JSON and its excerpt as text, for debugging."""
    paragraphs.repartition(1).write.mode("overwrite").json(f"{folder}/paragraphs_full")
    bundle.select("bundle").repartition(1).write.mode("overwrite").text(f"{folder}/retrieval_bundle")


def glossary(spark: SparkSession) -> DataFrame:
    """The fields with their types and meanings, in order."""
    return spark.createDataFrame([(i, n, k, DESCRIPTIONS[n]) for i, (n, k) in enumerate(FIELDS.items())], "place int, field string, type string, description string")


def audit_sheet(calls: DataFrame) -> DataFrame:
    """The long audit table as shown: sorted by operation and call."""
    return calls.select("operation", "call_id", "field", "value", "status", "citation_para", "quote", "source_document").orderBy("operation", "call_id")


def review_sheet(sample: DataFrame) -> DataFrame:
    """A sample with empty columns for a reviewer."""
    return sample.select("*", *[F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS])


def reviewed(sheet: DataFrame, column: str = REVIEW_COLUMNS[0]) -> DataFrame:
    """The rows that a reviewer has filled in."""
    return sheet.filter(F.trim(F.coalesce(column, F.lit(""))) != "")
