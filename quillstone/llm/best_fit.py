"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most one window; only longer ones are cut. How many
pieces there are of each length, at most one number a length, is all that the plan needs:
best fit, longest first, runs over these counts. Bins that look alike are one group, and a
length fills the group with the least room that still takes it, as many at a time as fit,
so the plan's size depends on the window alone and not on the number of documents. Its
rows are runs: so many pieces of one length, from one rank on, go to bins from one number
on, at one offset.

Pieces find their slots by joining on their rank within their length. A rank is the
piece's place among those of its length in its own partition (counted where it is made)
plus the counts of the partitions before it; those are summed by length over one row a
partition. Ranks are looked up in runs by (length, stretch of ranks), where a length has
as many stretches as runs, so a piece meets two runs on average.

Defined results: a null text is an empty one, a document of the end id only; repeated
rows and rows with null ids are documents of their own; other columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import default_path, tokenizer
from .support import Scratch, chunks, small_batches

WINDOW = 1024
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def plan_slots(histogram: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts of lengths: runs (length, first rank, number,
    first sequence, pieces a sequence, offset).

    Sequences with the same room are groups (first sequence, number). A piece goes to
    the least room that takes it; the next of the same length then finds the rest of that
    room to be the least, so a sequence gets all that fit before the next one."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    runs, sequences = [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                number = -(-left // (window // length))
                put(window, sequences, number)
                sequences += number
                continue
            room = rooms[at]
            first, number = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = min(room // length, left)
            bins = min(number, left // each)
            runs.append((length, rank, bins * each, first, each, window - room))
            put(room - each * length, first, bins)
            put(room, first + bins, number - bins)
            rank, left = rank + bins * each, left - bins * each
    return runs


def _cut(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in chunks(batches, "text", 4 << 20, owner="byte_tokens"):
            ids, total = tok.encode(batch.column("text"), end)
            ids = ids.view(np.uint8)
            count = -(-total // window)
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = total - (count - 1) * window  # the first piece may be shorter
            length = np.where(piece == 0, first[doc], window)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * window)
            # The place of each piece among those of its length.
            order = np.argsort(length, kind="stable")
            new = np.diff(length[order], prepend=-1) != 0
            began = np.flatnonzero(new)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(began, np.diff(np.append(began, len(doc)))) + seen[length[order]]
            seen += np.bincount(length, minlength=window + 1)
            at = np.append(0, np.cumsum(length)) * 4
            names = batch.column("doc_id").take(pa.array(doc))
            for i in range(0, len(doc), 1024):  # 4 MB of ids at most
                s = slice(i, i + 1024)
                n = len(doc[s])
                own = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at[i : i + n + 1] - at[i]), pa.py_buffer(ids[at[i] : at[i + n]])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [names[i : i + n], pa.array(piece[s].astype(np.int32)), pa.array(start[s]), pa.array(length[s].astype(np.int32)), own, pa.array(np.full(n, part, np.int32)), pa.array(nth[s])],
                    ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
                )

    return run


def cut_pieces(docs: DataFrame, *, window: int = WINDOW, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces as a stored table: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), and its place nth among those of its length in the partition part."""
    scratch = Scratch(docs.sparkSession, "best_fit")
    small_batches(docs.sparkSession)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.write(table.mapInArrow(_cut(tokenizer_path or default_path(), end_id, window), PIECES), "pieces")


def take_slots(pieces: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """pieces, any table with length, part and nth, with sequence_id and offset."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "best_fit_slots")
    counts = scratch.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # One row a length, of which there are no more than a window has ids.
    runs = plan_slots({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    number: dict[int, int] = {}
    total: dict[int, int] = {}
    for length, _, n, *_ in runs:
        number[length] = number.get(length, 0) + 1
        total[length] = total.get(length, 0) + n
    size = {k: -(-total[k] // number[k]) for k in number}
    listed = [(length, stretch, rank, rank + n, *rest) for length, rank, n, *rest in runs for stretch in range(rank // size[length], (rank + n - 1) // size[length] + 1)]
    slots = spark.createDataFrame(listed, "slot_length int, stretch long, low long, high long, first long, each long, place long")
    sizes = spark.createDataFrame(list(size.items()), "size_length int, size long")

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("base_length"), F.col("part").alias("base_part"), F.coalesce(before, F.lit(0)).alias("base"))
    bases = bases.join(F.broadcast(sizes), F.col("base_length") == F.col("size_length"))
    ranked = pieces.join(bases, (F.col("part") == F.col("base_part")) & (F.col("length") == F.col("base_length"))).withColumn("rank", F.col("base") + F.col("nth"))
    inside = (F.col("length") == F.col("slot_length")) & (F.expr("rank div size") == F.col("stretch")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    found = ranked.join(F.broadcast(slots), inside)
    out = found.select(*pieces.columns, (F.col("first") + F.call_function("div", turn, F.col("each"))).alias("sequence_id"), (F.col("place") + turn % F.col("each") * F.col("length")).alias("offset"))
    return out.drop("part", "nth")


def pack_best_fit(docs: DataFrame, *, window: int = WINDOW, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids, sequence_id and offset."""
    return take_slots(cut_pieces(docs, window=window, tokenizer_path=tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col), window=window)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids are summed up before the slots are joined, so that they stay where they are."""
    pieces = cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    slots = take_slots(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return slots.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
