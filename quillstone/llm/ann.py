"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns each unit vector; its hash is the nearest signed axis. Each of ``tables``
rotations is a table; a query also looks at the next-nearest axes (``probes``
buckets a table). Candidates are ranked by the exact inner product in double
precision, inside the bucket, so that only each bucket's best rows go on.

Equal vectors are one class: each is hashed and compared once, by a representative,
and stands for its smallest k + 1 ids. So a vector that a third of all rows repeat is
as cheap as any other.

Only directions are hashed, so a few long vectors do not push the others together.
Where lengths differ, the longest rows (``LONG`` of all) are compared with every
query, since they can lead at wide angles. A query that finds fewer than k rows is
compared with all rows.

The number of buckets does not follow the number of vectors, so the share of rows that
a query looks at stays, and with it the recall. A bucket is cut into blocks of about
``per_bucket`` rows and blocks of as many queries, and each pair of blocks is worked
off by itself, so no task holds a whole bucket. Measured recall at 20 with the
defaults is in the README.

Defined results: vectors that are null, all zero, hold a null or a non-finite
component, or have a null id take no part, neither as queries nor as candidates.
Vectors of different dimensions have no inner product: each dimension is searched by
itself. Repeated rows (one id, one vector) count once; an id with several vectors
counts by the nearest; a query never finds its own id. Ties go to the smaller id.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import BROADCAST_IDS, Scratch

TABLES, PROBES, SEED = 16, 8, 5
#: Rows, and queries, of a bucket that are compared at a time.
BLOCK = 2048
#: The share of rows, the longest ones, that every query is compared with.
LONG = 1 / 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / np.sqrt(width)


class Rotations:
    """The tables' pseudo-rotations; equal in every process."""

    def __init__(self, dim: int, tables: int, seed: int = SEED):
        self.dim = dim
        self.width = 1 << max(1, (dim - 1).bit_length())
        signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (tables, 3, self.width))
        self.signs = signs.astype(np.float32) * 2 - 1

    def __call__(self, x: np.ndarray, table: int) -> np.ndarray:
        for s in self.signs[table]:
            x = hadamard(x * s)
        return x

    def padded(self, x: np.ndarray) -> np.ndarray:
        """The rows' directions. Squares of very large or small numbers are avoided."""
        x = x.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        out = np.zeros((len(x), self.width), np.float32)
        out[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def keys(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The best buckets of each row, best first: |axis sum| ranks them."""
        first = self(x, table)
        kept = min(probes, self.width)
        axes = np.argsort(-np.abs(first), axis=1, kind="stable")[:, :kept]
        value = np.take_along_axis(first, axes, 1)
        return axes * 2 + (value > 0)


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("vector")
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[b:e] for b, e in zip(at, at[1:])]


def _hasher(tables: int, probes: int):
    """Adds own, a row's bucket in each table, and asks, the buckets that a query
    probes: probes of the first table, of the second, ..."""
    rotations: dict[int, Rotations] = {}

    def codes(x: np.ndarray, count: int) -> np.ndarray:
        if x.shape[1] not in rotations:
            rotations[x.shape[1]] = Rotations(x.shape[1], tables)
        turn = rotations[x.shape[1]]
        x = turn.padded(x)
        return np.concatenate([turn.keys(x, t, count) for t in range(tables)], axis=1).astype(np.int32)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                vectors, asking = _vectors(batch), batch.column("asking").to_numpy(zero_copy_only=False)
                own, asks = [None] * len(vectors), [[]] * len(vectors)
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    for i, c in zip(at, codes(np.stack([vectors[i] for i in at]), 1)):
                        own[i] = c
                    at = at[asking[at]]
                    if len(at):
                        for i, c in zip(at, codes(np.stack([vectors[i] for i in at]), probes)):
                            asks[i] = c
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, kind), pa.array(asks, kind)], [*batch.schema.names, "own", "asks"])

    return hashed


def exact_best(first: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k nearest rows by inner product in double precision,
    ties by first. A quick product picks the rows, with slack; the final sums do not
    depend on a row's place."""
    near = x @ q
    if len(near) > k:
        pick = np.flatnonzero(near >= np.partition(near, -k)[-k] - 1e-9 * (np.abs(near).max() + 1))
    else:
        pick = np.arange(len(near))
    score = (x[pick] * q).sum(axis=1)
    order = np.lexsort((first[pick], -score))[:k]
    return pick[order], score[order]


GROUP = ("dim", "t", "key", "block", "part")


def _searcher(k: int):
    """For each query of a group its k nearest rows there."""

    def best(held: list) -> Iterator[pa.RecordBatch]:
        rows, asks = ([r for r in held if r[0] is side] for side in (False, True))
        if not rows or not asks:
            return
        names, first = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        x = np.stack([r[3] for r in rows]).astype(np.float64)
        got = [exact_best(first, x, r[3].astype(np.float64), k) for r in asks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in asks], pa.int64()), pa.array([names[g[0]] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))],
            ["asker", "found", "scores"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in GROUP))
            for group, *row in zip(groups, *(batch.column(c).to_pylist() for c in ("is_query", "cls", "first")), _vectors(batch)):
                if group != at:
                    yield from best(held)
                    held, at = [], group
                held.append(row)
        yield from best(held)

    return search


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return table.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def _small(side: DataFrame) -> DataFrame:
    """Broadcast a stored table of short rows only if it is small."""
    return F.broadcast(side) if side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else side


def _nearest_classes(rows: DataFrame, asks: DataFrame, k: int, per_bucket: int, scratch: Scratch) -> DataFrame:
    """asker, cls, score: each query's k nearest rows among those that share a bucket
    with it. rows, asks: dim, t, key (the bucket), cls, first, vector."""
    bucket = ["dim", "t", "key"]
    every = rows.select(*bucket, F.lit(1).alias("r"), F.lit(0).alias("q")).unionByName(asks.select(*bucket, F.lit(0).alias("r"), F.lit(1).alias("q")))
    blocks = [F.ceil(F.sum(c) / per_bucket).cast("int").alias(name) for c, name in (("r", "blocks"), ("q", "parts"))]
    sizes = scratch.write(every.groupBy(*bucket).agg(*blocks).filter("blocks > 0 and parts > 0"), "sizes")
    few = _small(sizes)

    def own(count: str):
        return F.pmod(F.xxhash64("cls"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["cls", "first", "vector"]
    placed = rows.join(few, bucket).select(*bucket, own("blocks").alias("block"), each("parts").alias("part"), F.lit(False).alias("is_query"), *columns)
    probing = asks.join(few, bucket).select(*bucket, each("blocks").alias("block"), own("parts").alias("part"), F.lit(True).alias("is_query"), *columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.unionByName(probing).repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
    found = dealt.mapInArrow(_searcher(k), "asker long, found array<long>, scores array<double>")
    pairs = found.select("asker", F.explode(F.arrays_zip("found", "scores")).alias("x")).groupBy("asker", F.col("x.found").alias("cls")).agg(F.max("x.scores").alias("score"))
    return scratch.write(pairs, "pairs")


def _ranked(pairs: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from pairs of classes."""
    ids = pairs.join(classes.select("cls", "ids"), "cls").select("asker", "score", F.explode("ids").alias("vec_id"))
    ids = ids.groupBy("asker", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    # One more than k, since one of them may be the query itself.
    ids = ids.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1).drop("nth")
    own = queries.join(ids, queries["cls"] == ids["asker"]).filter("vec_id <> query_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, *, k: int = 20, every: int = 20, tables: int = TABLES, probes: int = PROBES, per_bucket: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every."""
    scratch = Scratch(table.sparkSession, "ann")
    rows = scratch.write(usable(table, id_col, vector_col).distinct(), "rows")
    # A class's ids beyond k + 1 can't be among the k nearest; hot classes are cut to
    # them before the shuffle.
    place = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1)
    asking = rows.filter(F.col("vec_id") % every == 0)
    named = least.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.write(named.select(F.monotonically_increasing_id().alias("cls"), F.col("ids")[0].alias("first"), "ids", "vector"), "classes")
    queries = scratch.write(asking.join(classes.select("cls", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "cls"), "queries")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    asked = queries.select("cls").distinct().withColumn("asking", F.lit(True))
    every_class = classes.join(asked, "cls", "left").select("cls", "first", "vector", F.coalesce("asking", F.lit(False)).alias("asking"), F.size("vector").alias("dim"), length.alias("length"))
    shape = f"cls long, first long, vector {dict(table.dtypes)[vector_col]}, asking boolean, dim int, length double, own array<int>, asks array<int>"
    hashed = scratch.write(every_class.mapInArrow(_hasher(tables, probes), shape), "hashed")

    columns = ["dim", "t", "key", "cls", "first", "vector"]
    in_table = hashed.select("dim", "cls", "first", "vector", F.posexplode("own").alias("t", "key")).select(*columns)
    probed = hashed.select("dim", "cls", "first", "vector", F.posexplode("asks").alias("at", "key"))
    probed = probed.withColumn("t", F.floor(F.col("at") / F.least(F.lit(probes), _width(F.col("dim")))).cast("int")).select(*columns)

    def whole(df: DataFrame, t: int) -> DataFrame:
        """All rows in one bucket of a table of their own."""
        return df.withColumn("t", F.lit(t)).withColumn("key", F.lit(0)).select(*columns)

    # Dimensions whose vectors differ in length, and the length of their longest rows.
    dims = hashed.groupBy("dim").agg(F.min("length").alias("low"), F.max("length").alias("high"), F.percentile_approx("length", 1 - LONG).alias("long"))
    uneven = scratch.write(dims.filter(F.col("high") - F.col("low") > 1e-6 * F.col("high")).select("dim", "long"), "uneven")
    if uneven.limit(1).count():
        side = _small(uneven)
        in_table = in_table.unionByName(whole(hashed.join(side, "dim").filter(F.col("length") > F.col("long")), -1))
        probed = probed.unionByName(whole(hashed.filter("asking").join(side.select("dim"), "dim", "left_semi"), -1))
    ranked = scratch.write(_ranked(_nearest_classes(in_table, probed, k + 1, per_bucket, scratch), classes, queries, k), "ranked")

    # Queries that found fewer rows than there are.
    most = rows.groupBy(F.size("vector").alias("dim")).agg((F.count_distinct("vec_id") - 1).alias("others"))
    got = ranked.groupBy("query_id").agg(F.count("*").alias("got"))
    due = queries.join(hashed.select("cls", "dim"), "cls").join(_small(scratch.write(most, "dims")), "dim").join(got, "query_id", "left")
    short = scratch.write(due.filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "others")).select("query_id").distinct(), "short")
    if not short.limit(1).count():
        return ranked
    # All vectors of an id are searched anew.
    again = scratch.write(queries.join(short, "query_id", "left_semi"), "again")
    lacking = hashed.join(again.select("cls").distinct(), "cls", "left_semi")
    pairs = _nearest_classes(whole(hashed, -2), whole(lacking, -2), k + 1, per_bucket, scratch)
    return ranked.join(short, "query_id", "left_anti").unionByName(_ranked(pairs, classes, again, k))


def _width(dim: Column) -> Column:
    """How many axes a rotation of that dimension has."""
    return F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(dim, F.lit(1)).cast("double"))))).cast("int")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
