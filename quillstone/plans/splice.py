"""Splicing two cash-flow sources at a cutoff, to find threshold months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import year_month

THRESHOLDS = (25, 50, 75)


def splice_thresholds(stream: DataFrame, approved: DataFrame, registry: DataFrame, *, cutoff: str = "2023-10-01", shift: int = 1, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """One row an operation of ``approved``.

    stream: operation, month, cumulative (up to the cutoff it is the anchor).
    approved: operation, approved (amount), and t25, t50, ... (months or null).
    registry: operation, month, amount; months are shifted, later ones are added.
    A threshold month that is known stays; a missing one is the first month whose
    share reaches it. Of several rows in an anchor's last month the largest counts.
    """
    end = F.lit(cutoff).cast("date")
    anchor = stream.filter((F.col("month") <= end) & F.col("cumulative").isNotNull()).groupBy("operation").agg(F.max_by(F.col("cumulative").cast("decimal(20,4)"), F.struct("month", "cumulative")).alias("anchor"))
    base = approved.dropDuplicates(["operation"]).join(anchor, "operation", "left")
    shifted = registry.select("operation", F.add_months("month", shift).alias("month"), F.col("amount").cast("decimal(20,4)").alias("amount")).filter(F.col("month") > end)
    flows = shifted.groupBy("operation", "month").agg(F.sum("amount").alias("amount"))
    valid = base.filter("anchor is not null and approved > 0").select("operation", "anchor", F.col("approved").cast("decimal(20,4)").alias("whole"))
    running = Window.partitionBy("operation").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = (F.col("anchor") + F.sum("amount").over(running)).cast("decimal(38,4)")
    shares = flows.join(valid, "operation").withColumn("total", total)
    reached = [F.min(F.when(F.col("total") * 100 >= F.col("whole") * t, F.col("month"))).alias(f"hit{t}") for t in thresholds]
    percent = lambda part, whole: F.rint(part.cast("double") * 100 / whole.cast("double") * 100) / 100
    found = shares.groupBy("operation").agg(F.count("*").alias("n"), F.max("month").alias("last"), F.max(percent(F.col("total"), F.col("whole"))).alias("after"), *reached)
    out = base.join(found, "operation", "left")
    columns = ["operation", F.col("n").isNotNull().alias("spliced"), F.coalesce("n", F.lit(0)).alias("n_spliced_months"), year_month(F.col("last")).alias("last_spliced_month"), F.when(F.col("approved") > 0, percent(F.col("anchor"), F.col("approved").cast("decimal(20,4)"))).alias("share_at_cutoff"), F.col("after").alias("share_after_splice")]
    for t in thresholds:
        columns += [year_month(F.col(f"t{t}")).alias(f"t{t}_orig"), year_month(F.coalesce(f"t{t}", f"hit{t}")).alias(f"t{t}_spliced"), (F.col(f"t{t}").isNull() & F.col(f"hit{t}").isNotNull()).alias(f"recovered_{t}")]
    return out.select(*columns)


def censoring(spliced: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Per threshold: censored before, recovered, censored after, and rates."""
    parts = ", ".join(f"{t}, t{t}_orig is null, recovered_{t}" for t in thresholds)
    rows = spliced.selectExpr(f"stack({len(thresholds)}, {parts}) as (threshold, missing, recovered)")
    found = rows.groupBy("threshold").agg(F.count("*").alias("n_ops"), F.count_if("missing").alias("censored_before"), F.count_if("recovered").alias("recovered"))
    after = F.col("censored_before") - F.col("recovered")
    rate = lambda c: F.rint(c / F.col("n_ops") * 1000) / 10
    return found.select("threshold", "n_ops", "censored_before", "recovered", after.alias("censored_after"), rate(F.col("censored_before")).alias("rate_before"), rate(after).alias("rate_after"))
