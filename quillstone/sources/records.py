"""Records that may span lines, read from one file by many tasks.

Spark's text source cuts a file into blocks and gives every line (what stands between two
separators) to the block where it begins. Whether a line's end is a record's end depends
on all lines before it: on the parity of quotes in a CSV file, on depth and strings in a
JSON map. So a first pass tells for each block what it does to the state it is entered
with, for both states of being in quotes; these are composed over a file's blocks, a row
each. The second pass enters every block in its state and cuts it into records. A record
that spans blocks leaves a piece in each, and these few pieces are joined.

Neither pass shuffles lines, and no task holds more than a record. What is broadcast is a
row a block (128 MB of input).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: line, whether it begins in quotes -> whether it ends in quotes, change of depth.
Step = Callable[[str, bool], tuple[bool, int]]
_TOKENS = re.compile(r'\\.|["{]', re.S)


def quote_step(line: str, inside: bool) -> tuple[bool, int]:
    """CSV: a quote opens or closes, and two in a row do both."""
    return inside ^ (line.count('"') % 2 == 1), 0


def brace_step(line: str, inside: bool) -> tuple[bool, int]:
    """JSON cut at closing braces: those in strings, and escaped quotes, don't count."""
    depth = 0
    for token in _TOKENS.findall(line):
        if token == '"':
            inside = not inside
        elif token == "{" and not inside:
            depth += 1
    return inside, depth - (not inside)


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict] | None]]:
    """The rows of each block in order, some at a time; None ends a block."""
    current = None
    for batch in batches:
        rows = batch.to_pylist()
        begin = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or (rows[i]["file"], rows[i]["block"]) != (rows[begin]["file"], rows[begin]["block"]):
                key = rows[begin]["file"], rows[begin]["block"]
                if current is not None and key != current:
                    yield current, None
                current = key
                yield key, rows[begin:i]
                begin = i
    if current is not None:
        yield current, None


def _effects(step: Step):
    """What each block does, entered outside and inside of quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(False, 0), (True, 0)]
        for (file, block), rows in _by_block(batches):
            if rows is None:
                out = {"file": file, "block": block, "out0": state[0][0], "depth0": state[0][1], "out1": state[1][0], "depth1": state[1][1]}
                yield pa.RecordBatch.from_pylist([out])
                state = [(False, 0), (True, 0)]
                continue
            for row in rows:
                for k, (inside, depth) in enumerate(state):
                    inside, change = step(row["value"], inside)
                    state[k] = inside, depth + change

    return run


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one file is entered."""
    pdf, inside, depth, rows = pdf.sort_values("block"), False, 0, []
    for r in pdf.itertuples():
        rows.append((r.file, r.block, inside, depth))
        inside, depth = (r.out1, depth + r.depth1) if inside else (r.out0, depth + r.depth0)
    return pd.DataFrame(rows, columns=["file", "block", "inside", "depth"])


def _cut(step: Step, separator: str, level: int):
    """Whole records, and the pieces of those that span blocks."""
    names = ["file", "block", "nth", "kind", "text", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        inside, depth, nth, own, fresh = False, 0, 0, True, True
        for (file, block), rows in _by_block(batches):
            out = []
            if rows is None:
                if held:
                    out.append((file, block, nth, "open" if own else "more", separator.join(held), False))
                held, nth, own, fresh = [], 0, True, True
            else:
                if fresh:
                    inside, depth, fresh = rows[0]["inside"], rows[0]["depth"], False
                    own = not inside and depth in (0, level)
                for row in rows:
                    held.append(row["value"])
                    inside, change = step(row["value"], inside)
                    depth += change
                    if not inside and depth == level:
                        out.append((file, block, nth, "whole" if own else "more", separator.join(held), True))
                        nth += own
                        held, own = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], names)

    return run


def split_records(spark: SparkSession, path: str, step: Step, separator: str, level: int = 0) -> DataFrame:
    """file, block, nth (together a record's place, in file order), text and ends, which
    is false for a last record that the file breaks off. A record ends with the first
    separator outside of quotes at which the depth is level."""
    lines = _lines(spark, path, separator)
    effects = lines.mapInArrow(_effects(step), "file string, block long, out0 boolean, depth0 long, out1 boolean, depth1 long")
    entry = effects.groupBy("file").applyInPandas(_composed, "file string, block long, inside boolean, depth long")
    cut = lines.join(F.broadcast(entry), ["file", "block"]).mapInArrow(_cut(step, separator, level), "file string, block long, nth long, kind string, text string, ends boolean")
    # The pieces of one record: an open one, then more in the blocks after it.
    order = F.col("kind") == "open"
    file = Window.partitionBy("file").orderBy("block", order)
    pieces = cut.filter("kind <> 'whole'").withColumn("chain", F.sum(order.cast("int")).over(file))
    listed = F.array_sort(F.collect_list(F.struct("block", order.alias("last"), "text", "nth")))
    joined = pieces.groupBy("file", "chain").agg(listed.alias("p"), F.bool_or("ends").alias("ends"))
    spanning = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["nth"].alias("nth"), F.array_join(F.transform("p", lambda x: x["text"]), separator).alias("text"), "ends")
    return cut.filter("kind = 'whole'").select(*spanning.columns).unionByName(spanning)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        texts = [t[:-1] if t.endswith("\r") else t for t in batch.column("text").to_pylist()]
        # A reader sees one record at a time, so a broken one does not reach into the next.
        rows = [next(csv.reader([t.removeprefix("﻿")]), []) if "\n" not in t else next(csv.reader(t.removeprefix("﻿").splitlines(keepends=True)), []) for t in texts]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.string()))], [*keep, "cells"])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth and cells of the rows of CSV files, the header among them; blank
    lines are no rows. Quotes that are text are doubled and inside quotes, as RFC 4180
    has it; lines end with a line feed, or a carriage return before it."""
    records = split_records(spark, path, quote_step, "\n").select("file", "block", "nth", "text")
    return records.mapInArrow(_cells, "file string, block long, nth long, cells array<string>").filter(F.size("cells") > 0)


def csv_header(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The first row of the first file, and that file; it is sought in the first lines."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise FileNotFoundError(path)
    lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(files[0]).limit(1000).collect()]
    rows = csv.reader(line + "\n" for line in lines)
    found = next((r for r in rows if r), [])
    return [c.removeprefix("﻿") if i == 0 else c for i, c in enumerate(found)], files[0]


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth and text of the entries of JSON files that are one map each of
    objects; a text is a map of one entry (and of those before it whose value is none)."""
    records = split_records(spark, path, brace_step, "}", level=1).filter("ends")
    return records.select("file", "block", "nth", F.concat(F.lit("{"), F.regexp_replace("text", r"^\s*[{,]", ""), F.lit("}}")).alias("text"))
