"""Month and period arithmetic. A month is the date of its first day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of_cell(c: Column) -> Column:
    """The month of a text cell whose first ten characters are a date."""
    return F.trunc(F.try_to_date(F.substring(F.trim(c.cast("string")), 1, 10), "yyyy-MM-dd"), "month")


def month_index(c: Column) -> Column:
    """Months since year 0."""
    return F.year(c) * 12 + F.month(c) - 1


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months from one month to another."""
    return month_index(later) - month_index(earlier)


def months(first: Column, last: Column) -> Column:
    """All months from first to last; null (no rows when exploded) if last is earlier."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))


def coded_month(c: Column) -> Column:
    """A month written like 1999m7."""
    at = r"^(\d{4})m(\d{1,2})$"
    text = F.trim(c.cast("string"))
    year, month = F.regexp_extract(text, at, 1), F.regexp_extract(text, at, 2)
    whole = text.rlike(at)
    made = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    return F.when(whole, made)


def year_month(c: Column) -> Column:
    """YYYY-MM."""
    return F.date_format(c, "yyyy-MM")


def period(c: Column, freq: str = "year") -> Column:
    """A year, or year-quarter, as text."""
    if freq == "year":
        return F.year(c).cast("string")
    return F.concat_ws("-", F.year(c).cast("string"), F.quarter(c).cast("string"))


def period_number(c: Column, freq: str = "year") -> Column:
    """Periods since year 0."""
    return F.year(c) if freq == "year" else F.year(c) * 4 + F.quarter(c) - 1


def period_name(number: Column, freq: str = "year") -> Column:
    if freq == "year":
        return number.cast("string")
    return F.concat_ws("-", F.floor(number / 4).cast("string"), (F.pmod(number, F.lit(4)) + 1).cast("string"))


def five_year_bucket(year: Column) -> Column:
    """1995s, 2000s, ...; a null year has a bucket of its own."""
    return F.coalesce(F.concat((F.floor(year / 5) * 5).cast("string"), F.lit("s")), F.lit("<NA>s"))
