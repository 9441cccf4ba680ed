"""Shares of a country's active portfolio by period, weighted by amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.months import month_index, period_name, period_number

SHARES = ("import_share", "cofinancing_share", "fx_foreign_share", "commodity_sector_share")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null if nothing is stated or all weights are 0; the plain mean if the stated
    values weigh nothing; else the weighted mean. Rounded half to even, to four places."""
    weight = weight.cast("decimal(20,4)")
    stated = F.sum(F.when(value.isNotNull(), weight))
    total = F.sum(weight)
    part = F.sum(F.when(value.isNotNull(), weight * value.cast("decimal(14,4)"))).cast("double") / stated.cast("double")
    plain = F.sum(value.cast("decimal(14,4)")).cast("double") / F.count(value)
    even = lambda c: F.rint(c * 10000) / 10000
    return F.when((F.count(value) == 0) | (total == 0), None).when(stated == 0, even(plain)).otherwise(even(part))


def active_periods(operations: DataFrame, horizon: str, freq: str = "year") -> DataFrame:
    """One row an operation and period at whose end it is active.

    operations: approval (date), spell_start (month), n_months, and other columns.
    An operation is active from its approval's period up to the one before its
    exit's, or to the horizon's without an exit: at the end of its exit's period it
    has left. So the interval join is a sequence, and no period scans the panel.
    """
    exit_index = month_index(F.col("spell_start")) + F.col("n_months")
    per = 12 if freq == "year" else 3
    exit_period = F.floor(exit_index / per)
    end = F.lit(horizon).cast("date")
    last = F.least(F.coalesce(exit_period - 1, period_number(end, freq)), period_number(end, freq)).cast("int")
    first = period_number(F.col("approval"), freq).cast("int")
    return operations.withColumn("period_number", F.explode(F.when(first <= last, F.sequence(first, last))))


def portfolio_shares(operations: DataFrame, horizon: str, freq: str = "year") -> DataFrame:
    """country, period, n_active and the shares.

    operations: operation, country, approval, spell_start, n_months, weight and the
    four share columns (null: not stated). Rows without country or approval go."""
    usable = operations.filter(F.col("country").isNotNull() & F.col("approval").isNotNull())
    rows = active_periods(usable, horizon, freq).withColumn("weight", F.coalesce("weight", F.lit(0)))
    found = rows.groupBy("country", "period_number").agg(F.count("*").alias("n_active"), *[weighted_mean(F.col(s), F.col("weight")).alias(s) for s in SHARES])
    return found.select("country", period_name(F.col("period_number"), freq).alias("period"), "n_active", *SHARES)
