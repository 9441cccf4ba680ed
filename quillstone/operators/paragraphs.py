"""Lines to numbered paragraphs.

A line that starts with a number like 2.9 opens a paragraph; every other line is
appended to the open one after a space, across pages, blank lines too. A page without such a line also gives a
row of its own (its first 4000 characters), although its lines were appended too.
A paragraph is emitted when the next one opens, so page rows come before the
paragraph that was open at the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBERED = r"(?s)^(\d{1,2}\.\d{1,2})\s+(.*)"
PAGE_CHARS = 4000


def segment_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """pages: key, page (1, 2, ...), text. Returns key, pos, para_id, page, text.

    Split, flag, and number by a running sum: three windows over one partitioning
    and order, so one sort a document."""
    # White space as Python and Java see it: trimmed line ends.
    lines = pages.select(key, "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    opens = F.col("line").rlike(NUMBERED)
    lines = lines.withColumn("opens", opens)
    order = Window.partitionBy(key).orderBy("page", "at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("para", F.sum(F.col("opens").cast("int")).over(order))
    body = F.when(F.col("opens"), F.regexp_extract("line", NUMBERED, 2)).otherwise(F.col("line"))
    paras = lines.filter("para > 0").groupBy(key, "para").agg(
        F.max(F.when(F.col("opens"), F.regexp_extract("line", NUMBERED, 1))).alias("para_id"), F.max(F.when(F.col("opens"), F.col("page"))).alias("page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "at", body.alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    # Emission: paragraph k when k + 1 opens, the last one at the end.
    nexts = lines.filter("opens").select(key, (F.col("para") - 1).alias("para"), F.col("page").alias("out_page"), F.col("at").alias("out_at"))
    paras = paras.join(nexts, [key, "para"], "left").select(key, F.coalesce("out_page", F.lit(2**31 - 1)).alias("out_page"), F.coalesce("out_at", F.lit(2**31 - 1)).alias("out_at"), "para_id", F.col("page").cast("string").alias("page"), "text")
    whole = lines.groupBy(key, "page").agg(F.max("opens").alias("any"), F.max(F.col("line") != "").alias("some"))
    texts = pages.select(key, "page", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    blank = texts.join(whole.filter("not any and some"), [key, "page"]).select(key, F.col("page").alias("out_page"), F.lit(2**31 - 2).alias("out_at"), F.concat(F.lit("page-"), F.col("page").cast("string")).alias("para_id"), F.col("page").cast("string").alias("page"), F.substring("text", 1, PAGE_CHARS).alias("text"))
    every = paras.unionByName(blank)
    place = Window.partitionBy(key).orderBy("out_page", "out_at")
    return every.withColumn("pos", F.row_number().over(place) - 1).select(key, "pos", "para_id", "page", "text")


def segment_word_paragraphs(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """paragraphs: key, at (0, 1, ...), text. As segment_pages, without pages: before
    the first number each non-blank paragraph is a row docx-p<n>, where n counts the
    rows from 1; afterwards everything is appended to the open paragraph."""
    t = paragraphs.select(key, "at", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("line")).filter("line <> ''")
    t = t.withColumn("opens", F.col("line").rlike(NUMBERED))
    order = Window.partitionBy(key).orderBy("at")
    t = t.withColumn("para", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("unit", F.when(F.col("para") == 0, F.row_number().over(order)).otherwise(F.lit(2**30) + F.col("para")))
    body = F.when(F.col("opens"), F.regexp_extract("line", NUMBERED, 2)).otherwise(F.when(F.col("para") == 0, F.substring("line", 1, PAGE_CHARS)).otherwise(F.col("line")))
    rows = t.groupBy(key, "unit").agg(F.max(F.when(F.col("opens"), F.regexp_extract("line", NUMBERED, 1))).alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", body.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    place = Window.partitionBy(key).orderBy("unit")
    rows = rows.withColumn("pos", F.row_number().over(place) - 1)
    return rows.select(key, "pos", F.coalesce("number", F.concat(F.lit("docx-p"), (F.col("pos") + 1).cast("string"))).alias("para_id"), F.lit("n/a").alias("page"), "text")
