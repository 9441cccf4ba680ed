"""Exact order statistics of many groups at once, without a task that sees a whole group.

Values are counted, dealt by ranges of (group, value) and sorted where they are. Each
range says how many values of each group it holds; sums over ranges, a row each, tell
which range holds a rank, and only these ranges are looked into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def order_statistics(table: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), linear: bool = True) -> DataFrame:
    """One row a group: the columns of by, n and q, an array of a value for each share.

    A share p stands at the place p * (n - 1) of the sorted values, from 0: linear takes
    the straight line between its two neighbours (as doubles), else the lower one counts.
    Nulls are left out, NaN is above all, and null groups are groups; without values
    there are no rows."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = table.filter(F.col(column).isNotNull()).select(key.alias("k"), F.col(column).alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    # The ranges come from a sample, so they are made once and stored.
    dealt = stored(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), needed=True)

    group = Window.partitionBy("k")
    before = F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = dealt.groupBy("k", "part").agg(F.sum("n").alias("m")).select("k", "part", "m", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(group).alias("total"))
    asked = spans.select("*", F.posexplode(F.array(*map(F.lit, map(float, shares)))).alias("i", "p")).withColumn("place", F.col("p") * (F.col("total") - 1))
    both = F.array(F.floor("place"), F.ceil("place")) if linear else F.array(F.floor("place"))
    asked = asked.select("*", F.posexplode(both).alias("side", "rank")).filter("rank >= before and rank < before + m")
    wanted = asked.select("k", "part", "total", "i", "side", (F.col("place") - F.floor("place")).alias("rest"), (F.col("rank") - F.col("before")).alias("nth"))

    upto = F.sum("n").over(Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    looked = dealt.join(wanted.select("k", "part").distinct(), ["k", "part"], "left_semi").withColumn("upto", upto)
    found = looked.join(wanted, ["k", "part"]).filter("nth < upto and nth >= upto - n")
    ends = found.groupBy("k", "total", "i").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"), F.max("rest").alias("rest"))
    low, high = F.col("low").cast("double"), F.coalesce("high", "low").cast("double")
    value = F.when(F.col("rest") == 0, low).otherwise(low + (high - low) * F.col("rest")) if linear else F.col("low")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("q")))), lambda x: x["q"])
    return ends.groupBy("k", "total").agg(listed.alias("q")).select(*[F.col(f"k.`{b}`") for b in by], F.col("total").alias("n"), "q")
