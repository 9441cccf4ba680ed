"""Cells, labels and lookups of panels. A value that can't be read is null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a record, in order, with their declared types.
FIELDS: dict[str, str] = {
    "cofinancing_present": "boolean",
    "cofinancing_share_pct": "number or null",
    "civil_works_type": "string or null",
    "construction_share_pct": "number or null",
    "procurement_modality": "string or null",
    "counterpart_funding_share_pct": "number or null",
    "fx_denomination": "string or null",
    "price_escalation_clause": "boolean or null",
    "executing_agency_type": "string or null",
    "safeguards_category": "string or null",
    "disbursement_period_years": "number or null",
    "goods_share_pct": "number or null",
    "first_year_disbursement_pct": "number or null",
    "conditions_prior_first_disbursement": "string or null",
    "retroactive_financing": "boolean or null",
    "advance_contracting": "boolean or null",
    "eligibility_date_stated": "string (YYYY-MM-DD) or null",
}
#: Short descriptions for prompts and the glossary.
DESCRIPTIONS: dict[str, str] = {
    "cofinancing_present": "Whether another lender co-finances the operation.",
    "cofinancing_share_pct": "Co-financed amount in percent of total cost.",
    "civil_works_type": "Kind of physical works.",
    "construction_share_pct": "Share of the budget for works and inspection.",
    "procurement_modality": "Procurement methods that are named.",
    "counterpart_funding_share_pct": "Share of cost paid by the borrower.",
    "fx_denomination": "Currency of the loan and any conversion option.",
    "price_escalation_clause": "Whether contracts adjust prices of inputs.",
    "executing_agency_type": "Kind of executing agency, and whether it is new.",
    "safeguards_category": "Environmental and social category.",
    "disbursement_period_years": "Planned years from first to last disbursement.",
    "goods_share_pct": "Share of cost for goods and equipment.",
    "first_year_disbursement_pct": "Share of the loan disbursed in year one.",
    "conditions_prior_first_disbursement": "Special conditions before the first disbursement.",
    "retroactive_financing": "Whether earlier expenditure may be financed.",
    "advance_contracting": "Whether procurement may begin before signature.",
    "eligibility_date_stated": "Calendar date of eligibility for disbursement.",
}
STATUSES = ("found", "stated_absent", "not_stated")
# Names of modality codes; codes whose instrument is an investment loan.
MODALITIES = {
    "ESP": "Specific Investment Operation", "PBL": "Policy-Based Loan", "PBP": "Programmatic Policy-Based Loan",
    "GOM": "Multiple Works Program", "SEF": "Sector Facility Loan", "LBR": "Results-Based Loan",
}
INSTRUMENTS = {
    "ESP": "Investment Loan", "GOM": "Investment Loan", "GCR": "Investment Loan", "PPE": "Investment Loan", "SEF": "Investment Loan",
    "TCR": "Investment Loan", "IRF": "Investment Loan", "LBR": "Investment Loan", "INO": "Investment Loan",
}
# The lender's own capital windows; ISO codes of borrowing countries.
OWN_CAPITAL = ("ORC", "FSO", "BLD")
ISO3 = {
    "Argentina": "ARG", "Bahamas": "BHS", "Barbados": "BRB", "Belize": "BLZ", "Bolivia": "BOL", "Brazil": "BRA",
    "Chile": "CHL", "Colombia": "COL", "Costa Rica": "CRI", "Dominican Republic": "DOM", "Ecuador": "ECU",
    "El Salvador": "SLV", "Guatemala": "GTM", "Guyana": "GUY", "Haiti": "HTI", "Honduras": "HND", "Jamaica": "JAM",
    "Mexico": "MEX", "Nicaragua": "NIC", "Panama": "PAN", "Paraguay": "PRY", "Peru": "PER", "Suriname": "SUR",
    "Trinidad and Tobago": "TTO", "Uruguay": "URY", "Venezuela": "VEN",
}
# Statuses before approval; instruments that are eligible.
NOT_APPROVED = ("pipeline", "proposed", "under preparation", "in preparation")
ELIGIBLE_INSTRUMENTS = ("Investment Loan", "Policy-Based Loan", "Policy-Based Financing")
NULL_CELLS = ("", "none", "nan", "null")


def cell(c: Column, kind: str) -> Column:
    """A cell in its canonical text: null words become null, booleans true or
    false, numbers as doubles; what doesn't parse stays as it is."""
    raw = F.trim(c.cast("string"))
    low = F.lower(raw)
    kept = F.when(~low.isin(*NULL_CELLS), raw)
    if "boolean" in kind:
        return F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no"), "false").otherwise(kept)
    if "number" in kind:
        return F.coalesce(kept.try_cast("double").cast("string"), kept)
    return kept


def number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def comparable(c: Column, kind: str) -> Column:
    """The form in which two coders' values are compared."""
    raw = F.trim(c.cast("string"))
    low = F.lower(raw)
    kept = F.when(~low.isin(*NULL_CELLS), low)
    if "boolean" in kind:
        return F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no"), "false").otherwise(kept)
    if "number" in kind:
        bare = F.trim(F.regexp_replace(kept, "[,%]", ""))
        return F.coalesce(hundredths(F.when(bare.rlike(NUMBER), bare.try_cast("double"))).cast("string"), kept)
    return kept


#: A number as a Python float is written, in lower case.
NUMBER = r"\A[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)\z"


def hundredths(c: Column) -> Column:
    """A double rounded to two places by its exact value: 2.675 lies below the half and
    goes down, 0.125 is a half and goes to the even neighbour.

    The product with 100 is taken with its error (the factor is split in two halves whose
    products are exact), so the half is told exactly. Numbers from 2 ** 44 on, whose
    neighbours are a hundredth apart or nearly so, stay as they are."""

    def rounded(x: Column) -> Column:
        product = x * 100
        split = x * 134217729.0
        high = split - (split - x)
        error = (high * 100 - product) + (x - high) * 100
        whole = F.floor(product)
        over = product - whole - 0.5
        up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
        return F.when(F.abs(x) < 2.0**44, (whole + F.when(up, 1).otherwise(0)).cast("double") / 100).otherwise(x)

    # An array of one binds the value, which is computed once.
    return F.transform(F.array(c), rounded)[0]


def lookup(c: Column, table: Mapping[str, str], keep_unknown: bool) -> Column:
    key = F.trim(c.cast("string"))
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return F.coalesce(found, key) if keep_unknown else found


def terminal_state(detail: Column, bulk: Column) -> Column:
    """cancelled, disbursed_complete, still_active or unknown: the detailed status
    first, then the bulk one; exact words."""
    own, other = F.trim(detail), F.trim(bulk)
    return (
        F.when(own == "Cancelled", "cancelled").when(own == "Closed", "disbursed_complete").when(own == "Implementation", "still_active")
        .when(other == "Active", "still_active").otherwise("unknown")
    )


def is_regional(country: Column) -> Column:
    return F.coalesce(F.contains(country, F.lit(";")), F.lit(False))


def iso3(country: Column, table: Mapping[str, str] = ISO3) -> Column:
    return F.when(~is_regional(country), lookup(country, table, False))


def sector_label(sector: Column, subsector: Column) -> Column:
    joined = F.concat_ws(" / ", F.coalesce(sector, F.lit("")), F.coalesce(subsector, F.lit("")))
    return F.btrim(joined, F.lit(" /"))


def titled(c: Column) -> Column:
    """Trimmed, and a capital after everything that is no letter ("On-Hold")."""
    letters = F.regexp_extract_all(F.lower(F.trim(c)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.nullif(F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), ""), F.lit(""))


def millions(c: Column) -> Column:
    """An amount in millions, to cents of a million, halves to even, in doubles."""
    return F.rint(c.cast("double") / 1_000_000 * 100) / 100


def display(c: Column, kind: str, missing: str) -> Column:
    """How a panel shows a value: Yes/No, one decimal for shares, or a label."""
    if kind == "boolean":
        return F.coalesce(F.when(c, "Yes").when(~c, "No"), F.lit(missing))
    if kind == "number":
        return F.coalesce(F.when(c.isNotNull(), F.format_string("%.1f", c.cast("double"))), F.lit(missing))
    return F.coalesce(c.cast("string"), F.lit(missing))


def imputed_share(share: Column, present: Column) -> Column:
    """A share; 0 where it is missing and the text says there is none."""
    low = F.lower(F.trim(present.cast("string")))
    return F.coalesce(number(share), F.when(low.isin("false", "no"), F.lit(0.0)))


def yes_no(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False)


def first_of(columns: list[str], *aliases: str) -> str:
    """The first alias that is a column."""
    for name in aliases:
        if name in columns:
            return name
    raise KeyError(f"none of {aliases} is a column")
