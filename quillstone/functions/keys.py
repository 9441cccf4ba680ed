"""Operation keys: two numbering schemes over a list of country prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COUNTRY_PREFIXES = (
    "AR", "BA", "BH", "BL", "BO", "BR", "CA", "CH", "CO", "CR", "DR", "EC", "ES", "GU", "GY",
    "HA", "HO", "JA", "ME", "NI", "PE", "PN", "PR", "RG", "RS", "SU", "TT", "UR", "VE",
)


def patterns(prefixes=COUNTRY_PREFIXES) -> dict[str, str]:
    """Regular expressions: any key, a loan's key, an old key, a listed key, a key
    inside text."""
    cc = "|".join(prefixes)
    return {
        "any": rf"^(?:{cc})(?:-[A-Z][0-9]{{3,5}}|[0-9]{{4}})$",
        "loan": rf"^(?:{cc})(?:-L[0-9]{{3,5}}|[0-9]{{4}})$",
        "old": rf"^(?:{cc})[0-9]{{4}}$",
        # Any two letters, loans and old keys only, exactly as written.
        "listed": r"^[A-Z]{2}(?:-L[0-9]{3,5}|[0-9]{4})$",
        "in_text": rf"\b(?:{cc})(?:-[A-Z][0-9]{{3,5}}|[0-9]{{4}})\b",
    }


def _key(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def is_operation(c: Column, prefixes=COUNTRY_PREFIXES) -> Column:
    return F.coalesce(_key(c).rlike(patterns(prefixes)["any"]), F.lit(False))


def is_loan(c: Column, prefixes=COUNTRY_PREFIXES) -> Column:
    return F.coalesce(_key(c).rlike(patterns(prefixes)["loan"]), F.lit(False))


def is_old_scheme(c: Column, prefixes=COUNTRY_PREFIXES) -> Column:
    return F.coalesce(_key(c).rlike(patterns(prefixes)["old"]), F.lit(False))


def keys_in(text: Column, prefixes=COUNTRY_PREFIXES) -> Column:
    """All keys in a text, upper-cased, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(patterns(prefixes)["in_text"]), F.lit(0)))
