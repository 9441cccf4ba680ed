"""Track records: what was known of the same group's earlier operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_record(operations: DataFrame, key: str, prefix: str, strict: bool = False) -> DataFrame:
    """Per operation: earlier operations of the same key, their mean duration and
    how many have one.

    operations: operation, approval (date), the key, n_months (null unless
    completed), and completed (date) if strict. Earlier means approved on an earlier
    day. Means are rounded half to even, to one place. strict counts a duration only if that operation was completed before the
    row's approval; otherwise durations that end later count too.

    Each key's days are summed first, so the running sums go over days, not over
    operations: a key that holds a third of all rows is still one short list of days.
    """
    day = F.unix_date("approval")
    usable = operations.filter(F.col("approval").isNotNull()).withColumn("day", day)
    opened = [F.count("*").alias("n"), F.count("n_months").alias("known"), F.sum("n_months").alias("total")]
    days = usable.filter(F.col(key).isNotNull()).groupBy(key, "day").agg(*(opened if not strict else opened[:1]))
    if strict:
        # A duration counts from the day of its completion on.
        done = usable.filter(F.col(key).isNotNull() & F.col("n_months").isNotNull() & F.col("completed").isNotNull())
        closed = done.groupBy(key, F.unix_date("completed").alias("day")).agg(F.count("*").alias("known"), F.sum("n_months").alias("total"))
        days = days.join(closed, [key, "day"], "full")
    before = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = days.select(key, "day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "known", "total")])
    out = usable.select("operation", key, "day").join(sums, [key, "day"], "left")
    mean = F.when(F.col("known") > 0, F.rint(F.col("total") / F.col("known") * 10) / 10)
    return out.select("operation", F.col("n").alias(f"{prefix}_prior_ops_count"), mean.alias(f"{prefix}_prior_avg_duration_months"), F.col("known").alias(f"{prefix}_prior_n_with_known_duration"))
