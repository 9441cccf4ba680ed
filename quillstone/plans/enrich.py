"""Enrichment of a panel with bulk metadata, a harvest log and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import values as v


def first_rows(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order column."""
    return table.groupBy(key).agg(F.min_by(F.struct(*table.columns), order).alias("r")).select("r.*")


def bulk_metadata(bulk: DataFrame, own_capital: Sequence[str] = v.OWN_CAPITAL) -> DataFrame:
    """One row an operation from one row a funding source.

    bulk: operation, row (file order), country, name, sector, subsector, modality,
    total_cost, approval_amount, funding_source, borrower, executing_agency,
    env_class, lending_type, status, approval_date, last_updated."""
    code = F.trim(F.substring_index(F.coalesce("funding_source", F.lit("")), "-", 1))
    own = code.isin(*own_capital)
    amount = F.coalesce(F.col("approval_amount").cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    keep = [c for c in bulk.columns if c not in ("operation", "approval_amount", "funding_source")]
    other = F.collect_set(F.when(~own & F.col("funding_source").isNotNull(), F.trim("funding_source")))
    found = bulk.filter(F.col("operation").isNotNull()).groupBy("operation").agg(
        F.sum(F.when(own, amount)).alias("own"), F.sum(F.when(~own, amount)).alias("cofin"), F.array_join(F.array_sort(other), "; ").alias("agency"), F.min_by(F.struct(*keep), "row").alias("r")
    )
    own_sum, cofin = F.coalesce("own", F.lit(0)), F.coalesce("cofin", F.lit(0))
    country = F.col("r.country")
    return found.select(
        "operation", country.alias("country"), v.is_regional(country).alias("is_regional"), v.iso3(country).alias("country_iso3"), F.col("r.name").alias("project_name"),
        v.sector_label(F.col("r.sector"), F.col("r.subsector")).alias("sector"), v.lookup(F.coalesce("r.modality", F.lit("")), v.MODALITIES, True).alias("modality"),
        v.millions(F.col("r.total_cost")).cast("double").alias("total_musd"), v.millions(own_sum).cast("double").alias("own_musd"), F.when(cofin > 0, v.millions(cofin)).cast("double").alias("cofinancing_musd"),
        F.nullif("agency", F.lit("")).alias("cofinancing_agency"), v.millions(F.col("r.total_cost").cast("decimal(20,4)") - own_sum - cofin).cast("double").alias("counterpart_musd"),
        F.col("r.borrower").alias("borrower"), F.col("r.executing_agency").alias("executing_agency"), F.col("r.env_class").alias("env_category"),
        (F.trim(F.coalesce("r.lending_type", F.lit(""))) == "Sovereign Guaranteed").alias("sovereign_guarantee"), v.titled(F.coalesce("r.status", F.lit(""))).alias("bulk_status"),
        F.col("r.approval_date").alias("approval_date"), F.col("r.last_updated").alias("last_updated"), v.lookup(F.col("r.modality"), v.INSTRUMENTS, False).alias("lending_instrument"),
    )


def fan_out_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join with a side that must have one row a key; a repeated key fails
    the job when the rows are read, instead of repeating rows silently."""
    counted = right.groupBy(key).agg(F.count("*").alias("__rows"), F.first(F.struct(*[c for c in right.columns if c != key])).alias("__r"))
    checked = counted.withColumn("__ok", F.when(F.col("__rows") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("int")).otherwise(1))
    joined = left.join(checked, key, "left")
    return joined.select(*[left[c] for c in left.columns], *[F.when(F.col("__ok") == 1, F.col(f"__r.{c}")).alias(c) for c in right.columns if c != key])


def add_missing(panel: DataFrame, side: DataFrame, key: str = "operation") -> DataFrame:
    """Left join of those columns that the panel doesn't have; the side is first
    reduced to one row a key."""
    new = [c for c in side.columns if c not in panel.columns and c != key]
    return fan_out_checked(panel, side.select(key, *new).dropDuplicates([key]), key) if new else panel


def enrich(panel: DataFrame, bulk: DataFrame, log: DataFrame, dates: DataFrame) -> DataFrame:
    """Panel with bulk metadata, what only the log knows, dates and terminal state."""
    out = add_missing(add_missing(fan_out_checked(panel, bulk, "operation"), log), dates)
    status = F.col("project_status") if "project_status" in out.columns else F.lit(None).cast("string")
    return out.withColumn("terminal_state", v.terminal_state(status, F.col("bulk_status")))


def display_panel(panel: DataFrame, kinds: dict[str, str], stated: Sequence[str]) -> DataFrame:
    """Columns as shown: missing fields are "not stated", joined ones "no source match"."""
    return panel.select(*[(v.display(F.col(c), kinds[c], "not stated" if c in stated else "no source match") if c in kinds else F.col(c)).alias(c) for c in panel.columns])


def candidates(bulk: DataFrame, start_year: int, end_year: int, pattern: str = keys.patterns()["listed"]) -> DataFrame:
    """Operations to harvest: key as listed, borrowing country, approval year, status;
    lending and project types only where those columns exist. The default pattern is
    looser in its countries and stricter in its spelling than keys.is_operation."""
    keep = F.col("operation").rlike(pattern) & F.col("country").isin(*v.ISO3) & F.year("approval_date").between(start_year, end_year) & ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*v.NOT_APPROVED)
    for column, value in (("project_type", "Loan Operation"), ("lending_type", "Sovereign Guaranteed")):
        if column in bulk.columns:
            keep = keep & (F.trim(column) == value)
    return bulk.filter(keep).select("operation").distinct()


def eligible(pages: DataFrame, start_year: int, end_year: int, trusted: bool = False) -> DataFrame:
    """Pages whose metadata allow the harvest; a trusted list only has to be approved."""
    approved = ~F.lower(F.trim(F.coalesce("project_status", F.lit("")))).isin(*v.NOT_APPROVED)
    if trusted:
        return pages.filter(approved)
    year = F.nullif(F.regexp_extract(F.coalesce("approval_date", F.lit("")), r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")
    return pages.filter(approved & F.col("country").isin(*v.ISO3) & F.col("lending_instrument").isin(*v.ELIGIBLE_INSTRUMENTS) & year.between(start_year, end_year))
