"""Exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of ``block_bytes`` bytes. The
distinct blocks are sorted and numbered; then adjacent pairs of names are named
the same way, level after level, until one name stands for each text. Two texts
get the same (level, name) exactly when they are equal: no hash decides it.

How the work is laid out:

* Only distinct blocks cross the network whole, after a map-side pre-aggregation,
  so a text that a third of all rows share is sent once by each task.
* Occurrences find a block's name by a 128-bit signature. The signatures are
  compared with the sorted blocks; if two different blocks share one, the salt is
  changed and the names are made again. So the lookup is exact for these data.
* Names and occurrences meet as two stored tables, so that Spark can split the
  partitions of a hot name (adaptive skew join).

Built of DataFrame functions only.

Defined results: a null text counts as empty; empty texts are equal to each
other. Of equal texts, the row with the most code points stays, then the smallest
doc_id (null ids last), then the first row read; so of rows that repeat id and
text exactly one is kept. Other columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Scratch, only_ids, without_ids

BLOCK_BYTES = 8192
#: The characters that do not count: space, and tab to carriage return.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without white space; null becomes empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _blocks(norm: str, size: int) -> Column:
    """The text's UTF-8 bytes in blocks; an empty text is one empty block."""
    raw = F.col(norm).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(F.col(norm)) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _signature(block: Column, salt: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(salt), block), F.xxhash64(F.lit("second"), F.lit(salt), block)


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with a number each: every partition sorts its keys and
    counts on from its own base."""
    return df.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(texts: DataFrame, scratch: Scratch, size: int) -> tuple[DataFrame, int]:
    """Names of the distinct blocks by signature, and the salt that tells all of
    them apart."""
    salt = 0
    while True:
        s1, s2 = _signature(F.col("block"), salt)
        names = scratch.write(_numbered(texts.select(F.explode(_blocks("norm", size)).alias("block")), "block").select(s1.alias("s1"), s2.alias("s2"), "name"), "names")
        clash = names.groupBy("s1", "s2").count().filter("count > 1").limit(1).count()
        if not clash:
            return names, salt
        salt += 1


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256,
    n_code_points, level and name (together the identity of its text)."""
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_code_points"), normalised(F.col(text_col)).alias("norm"))
    names, salt = _name_blocks(texts, scratch, block_bytes)

    occurrences = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_code_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(_blocks("norm", block_bytes), lambda b: F.struct(_signature(b, salt)[0].alias("s1"), _signature(b, salt)[1].alias("s2"))).alias("signs"),
    )
    table = scratch.write(occurrences, "documents")
    signs = table.select("row", F.size("signs").alias("n"), F.posexplode("signs").alias("pos", "sign"))
    level = scratch.write(signs.select("row", "n", "pos", F.col("sign.s1"), F.col("sign.s2")).join(names, ["s1", "s2"]).select("row", "n", "pos", "name"), "level")

    done = [level.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    longest = table.select(F.max(F.size("signs"))).first()[0] or 1
    depth = 0
    while longest > 1:
        depth, longest = depth + 1, (longest + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.filter("n > 1").groupBy("row", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = scratch.write(pairs, "pairs")
        pair_names = scratch.write(_numbered(pairs.select("a", "b"), "a", "b"), "pair_names")
        level = scratch.write(pairs.join(pair_names, ["a", "b"]).select("row", "n", "pos", "name"), "level")
        done.append(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))

    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    named = scratch.write(table.drop("signs").join(identity, "row"), "named")
    best = F.min(F.struct((-F.col("n_code_points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = scratch.write(named.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_code_points", "level", "name",
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that exact_dedup keeps, with their own columns. Rows that repeat a
    kept id and text are one row afterwards."""
    scratch = Scratch(docs.sparkSession, "drop_exact")
    found = scratch.write(exact_dedup(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes).select("doc_id", "kept", "text_sha256", "n_code_points"), "found")
    touched = scratch.write(found.filter("not kept").select("doc_id").distinct(), "touched")
    # Ids of which one row goes and another stays are told apart by text.
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"), F.col("n_code_points").alias("__kept_n"))
    mixed = scratch.write(kept.join(touched, F.col("__kept_id").eqNullSafe(touched["doc_id"]), "left_semi"), "mixed")
    rest = without_ids(docs, touched, id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = only_ids(docs, scratch.write(mixed.select("__kept_id").distinct(), "mixed_ids"), id_col)
    some = some.withColumn("__sha", F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).withColumn("__n", F.length(text).cast("long"))
    some = some.join(mixed, some[id_col].eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")) & (F.col("__n") == F.col("__kept_n")))
    return rest.unionByName(some.dropDuplicates(["__kept_id", "__sha", "__n"]).select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
