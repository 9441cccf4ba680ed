"""Batches of folders under a disk budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_sizes(files: DataFrame, key: str = "operation", suffixes: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """files: key, path, length. Bytes by folder, of the known suffixes only."""
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    return files.groupBy(key).agg(F.coalesce(F.sum(F.when(known, F.col("length"))), F.lit(0)).alias("bytes"))


def plan_batch(sizes: DataFrame, free_gb: float, margin: float = 0.7, key: str = "operation") -> DataFrame:
    """The folders of the next batch, in name order: key, bytes, used.

    The choice depends on all before it, so one ordered pass streams the list of
    folders (one short row each) through a single task; it never collects them."""
    budget = int(free_gb * margin * 2**30)
    shape = sizes.select(key, "bytes").schema

    def run(parts):
        left = budget
        for part in parts:
            keep = []
            for n in part["bytes"]:
                keep.append(n <= left)
                left -= n if keep[-1] else 0
            yield part[keep]

    # An exchange, so that the sums before it keep their own tasks.
    ordered = sizes.select(key, "bytes").repartition(1).sortWithinPartitions(key)
    return ordered.mapInPandas(run, shape)
