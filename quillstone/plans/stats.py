"""Distributions, sampling, scoring and coverage diagnosis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import five_year_bucket
from ..functions.text import words_of
from ..functions.values import FIELDS, STATUSES, comparable
from ..session import stored
from ..sources.sinks import reviewed
from .quantiles import order_statistics

# Key prefixes of borrowers whose documents are in English.
ENGLISH = ("BA", "BH", "BL", "GY", "JA", "TT")
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def describe(table: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """count, mean, sample deviation, min, linearly interpolated percentiles, max."""
    c = F.col(column)
    one = table.filter(c.isNotNull()).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    both = one.join(F.broadcast(order_statistics(table, column, percentiles).select("q")), how="left")
    return both.select("n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(percentiles)], "max")


def by_group(table: DataFrame, group: Column, column: str) -> DataFrame:
    """count, mean, median by group; a null group is left out."""
    c = F.col(column)
    rows = table.withColumn("grp", group).filter(F.col("grp").isNotNull() & c.isNotNull())
    middle = order_statistics(rows, column, [0.5], ["grp"]).select("grp", F.col("q")[0].alias("median"))
    return rows.groupBy("grp").agg(F.count(c).alias("n"), F.avg(c).alias("mean")).join(middle, "grp")


def by_five_years(table: DataFrame, year: Column, column: str) -> DataFrame:
    """As by_group; rows without a year have a bucket."""
    return by_group(table, five_year_bucket(year), column)


def histogram(table: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from the least to the largest value; the last bin
    includes its upper end. The two bounds are one row, joined by broadcast."""
    c = F.col(column).cast("double")
    ends = table.agg(F.min(c).alias("low"), F.max(c).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((c - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return table.filter(c.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def stratified_sample(table: DataFrame, strata: Sequence[str], key: Sequence[str], k: int = 5, seed: int = 20260922) -> DataFrame:
    """Up to k rows of each stratum, the ones with the smallest seeded hash."""
    order = F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))
    place = Window.partitionBy(*strata).orderBy(order, *key)
    return table.filter(" and ".join(f"`{s}` is not null" for s in strata)).withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k).drop("nth")


def agreement(scored: DataFrame, field: str = "field", agree: str = "agree") -> DataFrame:
    """Number, agreements and rate of each field, and of all ("(all)")."""
    ok = F.col(agree).cast("int")
    rows = scored.rollup(field).agg(F.count("*").alias("n"), F.sum(ok).alias("n_agree"), F.grouping(field).alias("whole"))
    rate = F.rint(F.col("n_agree") / F.col("n") * 1000) / 1000
    return rows.select(F.when(F.col("whole") == 1, "(all)").otherwise(F.col(field)).alias("field"), "n", "n_agree", rate.alias("rate"))


def score_validation(sheet: DataFrame, types: Mapping[str, str] = FIELDS) -> DataFrame:
    """Agreement of extracted and hand-coded values by field and in all. sheet: field,
    extracted_value, hand_coded_value; rows without a hand-coded value wait. Values are
    compared in the form of their field's type, and two missing ones agree."""
    done = reviewed(sheet)

    def shown(c: str) -> Column:
        out = comparable(F.col(c), "string")
        for kind in ("boolean", "number"):
            named = [f for f, k in types.items() if kind in k]
            out = F.when(F.col("field").isin(*named), comparable(F.col(c), kind)).otherwise(out)
        return out

    return agreement(done.select("field", shown("extracted_value").eqNullSafe(shown("hand_coded_value")).alias("agree")))


def status_by_field(calls: DataFrame, n_ops: Column, statuses: Sequence[str]) -> DataFrame:
    """Calls by field and status, and the found share of all operations."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    out = calls.groupBy("field").agg(*counts)
    return out.withColumn("found_pct", F.rint(F.col(statuses[0]) / n_ops * 1000) / 10)


def lower_quantiles(table: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank values s[int(p * (n - 1))] of the sorted values, by group; without
    values and groups one row of nulls."""
    found = order_statistics(table, column, shares, by, linear=False)
    picks = [F.col("q")[i].alias(f"q{round(p * 100):02d}") for i, p in enumerate(shares)]
    return found.select(*by, *picks) if by else found.agg(F.max("q").alias("q")).select(*picks)


def health(operations: DataFrame, cap: int = 24_000) -> DataFrame:
    """Operations without paragraphs, without relevant ones (those without any among
    them), at the cap, and with unread documents. operations: n_paragraphs, n_relevant, n_chars, n_failed."""
    return operations.agg(
        F.count("*").alias("n_ops"), F.count_if(F.col("n_paragraphs") == 0).alias("zero_parsed"), F.count_if(F.col("n_relevant") == 0).alias("zero_relevant"),
        F.count_if(F.col("n_chars") >= cap).alias("capped"), F.sum("n_failed").alias("failed_documents"), F.count_if(F.col("n_failed") > 0).alias("failed_ops"),
    )


def by_language(operations: DataFrame, english: Sequence[str] = ENGLISH) -> DataFrame:
    """Retrieval by the borrower's language, told by the key up to its hyphen; keys
    of the old scheme have none and count as other. Ratios are of sums.
    operations: operation, n_paragraphs, n_relevant, n_found."""
    language = F.when(F.substring_index("operation", "-", 1).isin(*english), "English").otherwise("other")
    sums = operations.groupBy(language.alias("language")).agg(F.count("*").alias("n_ops"), F.sum("n_relevant").alias("r"), F.sum("n_paragraphs").alias("t"), F.sum("n_found").alias("f"), F.count_if(F.col("n_relevant") == 0).alias("z"))
    percent = lambda a, b: F.when(b > 0, F.rint(a / b * 1000) / 10)
    return sums.select("language", "n_ops", percent(F.col("r"), F.col("t")).alias("relevant_pct"), (F.rint(F.col("f") / F.col("n_ops") * 100) / 100).alias("found_per_op"), percent(F.col("z"), F.col("n_ops")).alias("zero_relevant_pct"))


def value_counts(table: DataFrame, column: str) -> DataFrame:
    """Rows by value, nulls included."""
    return table.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def share_of_stated(table: DataFrame, flags: Sequence[str]) -> DataFrame:
    """For each flag: rows where it is true, rows where it is stated, and the share."""
    parts = ", ".join(f"'{f}', `{f}`" for f in flags)
    rows = table.selectExpr(f"stack({len(flags)}, {parts}) as (flag, value)")
    found = rows.groupBy("flag").agg(F.count_if("value").alias("n_true"), F.count("value").alias("n_stated"))
    return found.withColumn("share", F.when(F.col("n_stated") > 0, F.rint(F.col("n_true") / F.col("n_stated") * 1000) / 1000))


def before_after(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two runs over the same keys side by side."""
    left = before.select(key, *[F.col(c).alias(f"{c}_before") for c in columns])
    right = after.select(key, *[F.col(c).alias(f"{c}_after") for c in columns])
    return left.join(right, key)


def passage_checks(quotes: DataFrame, before: DataFrame, after: DataFrame, key: str = "operation", head: int = 60) -> DataFrame:
    """Whether the first characters of each quote, as words, stand in an operation's
    excerpt of one run and of another. quotes: key, field, quote; excerpts: key, bundle.
    An empty quote, and an operation without an excerpt, count as absent."""
    rows = quotes.withColumn("head", F.substring(words_of(F.coalesce("quote", F.lit(""))), 1, head))
    for name, bundles in (("in_before", before), ("in_after", after)):
        side = bundles.select(key, words_of(F.coalesce("bundle", F.lit(""))).alias("excerpt"))
        there = (F.col("head") != "") & F.contains("excerpt", F.col("head"))
        rows = rows.join(side, key, "left").withColumn(name, F.coalesce(there, F.lit(False))).drop("excerpt")
    return rows.select(key, "field", "head", "in_before", "in_after")


def diagnose(audit: DataFrame, statuses: Sequence[str] = STATUSES, cap: int = 24_000) -> dict[str, DataFrame]:
    """An audit's diagnosis: statuses by field, health, quantiles of what was parsed,
    and the comparison by language. audit: operation, stats, fields (see load_audit)."""
    # Every part reads the audit, a row an operation; what it is made of may be texts.
    audit = stored(audit, needed=True)
    none = lambda c: F.coalesce(F.col(f"stats.{c}"), F.lit(0))
    fields = F.coalesce("fields", F.array().cast(audit.schema["fields"].dataType))
    ops = audit.select(
        "operation", none("n_paragraphs_total").alias("n_paragraphs"), none("n_paragraphs_relevant").alias("n_relevant"), none("bundle_chars").alias("n_chars"),
        none("n_documents_failed").alias("n_failed"), F.size(F.filter(fields, lambda f: f["status"] == statuses[0])).alias("n_found"),
    )
    total = audit.agg(F.count("*").alias("n_ops"))
    calls = audit.select(F.explode("fields").alias("c")).select("c.field", "c.status")
    by_field = calls.groupBy("field").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses]).crossJoin(F.broadcast(total))
    by_field = by_field.withColumn("found_pct", F.rint(F.col(statuses[0]) / F.col("n_ops") * 1000) / 10).drop("n_ops")
    measures = ("n_paragraphs", "n_relevant", "n_chars")
    long = ops.selectExpr(f"stack({len(measures)}, {', '.join(f"'{m}', {m}" for m in measures)}) as (measure, v)")
    spread = lower_quantiles(long, "v", (0.25, 0.5, 0.75), ["measure"]).join(long.groupBy("measure").agg(F.max("v").alias("max")), "measure")
    return {"status": by_field, "health": health(ops, cap), "quantiles": spread, "language": by_language(ops)}


def recall(paragraphs: DataFrame, key: str, expected: str, there: str) -> DataFrame:
    """Per key: paragraphs that should be retrieved, and those that were."""
    return paragraphs.groupBy(key).agg(F.count_if(expected).alias("n_expected"), F.count_if(F.col(expected) & F.col(there)).alias("n_retrieved"))
