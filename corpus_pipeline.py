"""The corpus pipeline: language, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages' results
are written as Parquet and read again as the next stage's documents. A stage's own
tables, and the documents that the next stage has read, are deleted when they have
served.

Defined results: rows, not ids, are judged, so of rows that share an id (or have none)
each goes or stays by its own text. Null, empty and blank texts have no language and
go in the first stage. Extra columns pass through all stages but the last, under any
name. An empty table gives no pieces. Labelled languages are learned from the table
itself; without any, no text has a recognised language and nothing is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.exact_dedup import drop_exact_duplicates
from quillstone.llm.language_id import keep_known_language
from quillstone.llm.near_dedup import drop_near_duplicates
from quillstone.llm.packing import digest, pack_documents
from quillstone.llm.pii import sanitise
from quillstone.llm.support import Scratch, freeing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return keep_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays (similarity 0.8 or more)."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are replaced by marks."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 4096 ids. The workers have served other
    stages before, so they remember fewer words here."""
    return digest(pack_documents(docs, cache_bytes=40_000_000))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: No stage but exact dedup can be said in SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        with freeing():
            kept = scratch.write(stage(spark, docs, sf_dir), name)
        if at:  # never the input itself
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
