"""Calendar tables: months of a health emergency, election years, shock series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import months

# First and last month of the emergency and of its acute phase.
EMERGENCY, ACUTE = ("2020-01-01", "2023-05-01"), ("2020-03-01", "2021-06-01")


def month_table(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row a month, both ends included."""
    day = lambda d: F.lit(d).cast("date")
    return spark.range(1).select(F.explode(months(day(start), day(end))).alias("date"))


def covid_exposure(spark: SparkSession, start: str = "1998-01-01", end: str = "2030-12-01") -> DataFrame:
    inside = lambda w: F.col("date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    return month_table(spark, start, end).select(
        F.year("date").alias("year"), F.month("date").alias("month"), F.date_format("date", "yyyy-MM").alias("yyyymm"),
        inside(EMERGENCY).cast("int").alias("covid_pheic"), inside(ACUTE).cast("int").alias("covid_acute"),
        F.when(inside(ACUTE), 2).when(inside(EMERGENCY), 1).otherwise(0).alias("covid_intensity"),
    )


def election_grid(elections: DataFrame, start_year: int = 1998, end_year: int = 2026) -> DataFrame:
    """Every country of ``elections`` with every year; the year's election types.

    elections: country, election_date, election_type. A country without any row is
    absent, which must not be read as "no elections"."""
    countries = elections.filter("country is not null").select("country").distinct()
    grid = countries.withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))))
    kinds = elections.filter("election_date is not null").groupBy("country", F.year("election_date").alias("year")).agg(F.array_join(F.array_sort(F.collect_set("election_type")), ";").alias("election_type"))
    return grid.join(kinds, ["country", "year"], "left").select("country", "year", F.col("election_type").isNotNull().cast("int").alias("is_election_year"), "election_type")


def monthly_mean(series: DataFrame) -> DataFrame:
    """series: name, date, value. Means by month; nulls are skipped."""
    rows = series.filter("value is not null and date is not null")
    return rows.groupBy(F.col("name").alias("shock_name"), F.year("date").alias("year"), F.month("date").alias("month")).agg((F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count("*")).alias("value"))


def shock_table(frames: list[DataFrame]) -> DataFrame:
    """The long table of all series that could be read; none is an error."""
    if not frames:
        raise ValueError("no series could be read")
    return reduce(DataFrame.unionByName, [f.select("year", "month", "shock_name", "value") for f in frames])


def coverage(shocks: DataFrame) -> DataFrame:
    """Months, first and last month of each series."""
    at = F.format_string("%04d-%02d", "year", "month")
    return shocks.groupBy("shock_name").agg(F.count("*").alias("n_months"), F.min(at).alias("first_month"), F.max(at).alias("last_month"))
