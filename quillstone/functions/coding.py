"""Coding of free text by ordered and by independent regular expressions.

Patterns see lower-cased, trimmed text. (?U) makes word boundaries and classes
treat accented letters as letters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders that mean nothing was said.
MISSING = ("", "nan", "none", "not stated", "no source match")
# Level of government, first match wins.
AGENCY_LEVEL = {
    "municipal": (r"\bmunicipal", r"\bmunicip", r"\bcity\b", r"\bprefeitura"),
    "subnational": (r"\bsubnational", r"\bprovincial", r"\bstate government", r"\bstate of\b", r"\bdepartamental", r"\bregional government", r"\bgobierno provincial", r"\bestado de\b", r"\bprovince"),
    "national": (r"\bnational\b", r"\bfederal\b", r"\bcentral government", r"\bnacional\b", r"\bministry\b", r"\bministerio", r"\bministério"),
    "regional": (r"\bregional\b", r"\bmultinational", r"\bsupranational"),
}
# Legal form, first match wins.
AGENCY_FORM = {
    "financial_intermediary": (r"\bfinancial intermediar", r"\bsecond[- ]tier", r"\bdevelopment bank", r"\btrust fund\b", r"\bbanco de", r"\bbank\b.*\b(develop|export|comercio)"),
    "autonomous_agency_soe": (r"\bstate[- ]owned", r"\bsoe\b", r"\bautonomous\b", r"\bpublic enterprise", r"\bempresa p[uú]blica", r"\bautarqu", r"\bdecentralised\b", r"\bdecentralized\b"),
    "ministry_or_secretariat": (r"\bministry\b", r"\bministerio", r"\bministério", r"\bsecretariat\b", r"\bsecretar[ií]a", r"\bdepartment\b"),
    "project_unit": (
        r"\bproject (execution|management|coordination) unit", r"\bexecuting unit", r"\bunidad ejecutora", r"\bunidade executora", r"\bpmu\b", r"\bpiu\b",
        r"\b(coordination|coordinating|execution)\b.{0,30}\bunit\b", r"\bunit\b.{0,30}\b(coordination|execution)\b", r"\bunidad de (coordinaci[oó]n|ejecuci[oó]n)",
        r"\bsub-?executing\b", r"\bexecution unit", r"\bsub[- ]?executing agenc",
    ),
    "other_branch_of_state": (r"\blegislative\b", r"\bjudicial\b", r"\bcomptroller\b", r"\bsenate\b", r"\bcongress\b", r"\belectoral\b"),
}
# Whether the unit was created for the operation; true is asked first.
NEWLY_CREATED = {
    True: (r"\bnewly created", r"\bnewly[- ]established", r"\bto be created", r"\bwill be created", r"\bnueva\b.*\bunidad", r"\bde nueva creaci[oó]n", r"\bcreated for (this|the) (program|project|operation)", r"\ba ser creada"),
    False: (r"\bexisting\b", r"\balready (exists|established)", r"\bnot newly", r"\bexistente\b", r"\bya existente"),
}
# Currency flags.
CURRENCY = {
    "fx_usd": (r"\bu\.?s\.?a?\.?\s*dollar", r"\bdollars? of the united states", r"\bd[oó]lar", r"\busd\b", r"\bunited states dollar", r"us\s*\$", r"\bus\$", r"united states of americ\w* dollar"),
    "fx_single_currency_facility": (r"single currency facility", r"\bscf\b", r"facilidad de moneda [uú]nica"),
    "fx_ordinary_capital": (r"ordinary capital", r"capital ordinario", r"\boc\b"),
    "fx_concessional": (r"fund for special operations", r"\bfso\b", r"fondo de operaciones especiales", r"concessional"),
    "fx_local_currency_option": (r"local currency", r"moneda local", r"conversion to local", r"convertible a moneda"),
}
# Procurement flags.
PROCUREMENT = {
    "proc_icb": (r"\bicb\b", r"international competitive bidding", r"licitaci[oó]n p[uú]blica internacional", r"\blpi\b"),
    "proc_ncb": (r"\bncb\b", r"national competitive bidding", r"licitaci[oó]n p[uú]blica nacional", r"\blpn\b"),
    "proc_shopping": (r"\bshopping\b", r"comparison of prices", r"price comparison", r"comparaci[oó]n de precios", r"compara[cç][aã]o de pre[cç]os"),
    "proc_direct": (r"direct contracting", r"contrataci[oó]n directa", r"sole source", r"single source", r"selecci[oó]n directa"),
    "proc_consultants": (r"individual consultant", r"consultor(es)? individual", r"\bqcbs\b", r"quality[- ]and[- ]cost", r"\bsbcc\b", r"selection based on quality"),
    "proc_force_account": (r"force account", r"administraci[oó]n directa", r"por administraci[oó]n"),
    "proc_national_law": (
        r"national procurement (law|act|system)", r"ley de contrataci", r"public procurement act", r"r[eé]gimen nacional", r"private sector procurement",
        r"pr[aá]cticas del sector privado", r"national systems?\b", r"procedimientos nacionales", r"sistemas? nacional", r"national procedures",
    ),
    "proc_bidding_unspecified": (r"^licitaci[oó]n p[uú]blica\s*$", r"\bbank standard procedures", r"\bmarket procurement practices", r"\bcompetitive bidding\b", r"\blocal competitive bidding", r"\bpr[aá]cticas comerciales"),
}
# Words of a local currency and of commodity sectors.
LOCAL_CURRENCY = ("local currency", "national currency", "moneda local", "moeda local")
COMMODITY_SECTORS = ("energy", "agricult", "mining", "extractive", "oil", "gas", "mineral")


def any_of(patterns: Sequence[str]) -> str:
    """One expression for all patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def stated(c: Column) -> Column:
    """Trimmed lower case; placeholders become null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(~low.isin(*MISSING), low)


def matches(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?U)" + any_of(patterns))


def first_match(c: Column, table: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The first class one of whose patterns is found; null text has none."""
    out = F.lit(otherwise)
    for name, patterns in reversed(table.items()):
        out = F.when(matches(c, patterns), F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def agency_level(c: Column) -> Column:
    return first_match(c, AGENCY_LEVEL, "level_not_stated")


def agency_form(c: Column) -> Column:
    return first_match(c, AGENCY_FORM, "other")


def newly_created(c: Column) -> Column:
    """True patterns are asked before false ones, so "not newly created" is true."""
    return F.when(matches(c, NEWLY_CREATED[True]), True).when(matches(c, NEWLY_CREATED[False]), False)


def flags(c: Column, table: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """A boolean for each name; null where the text is null."""
    return {name: matches(c, patterns) for name, patterns in table.items()}


def procurement_flags(c: Column, table: Mapping[str, Sequence[str]] = PROCUREMENT) -> dict[str, Column]:
    """Flags, and their number. Unspecified bidding is only that: false beside the
    international or national kind."""
    out = flags(c, table)
    out["proc_bidding_unspecified"] = out["proc_bidding_unspecified"] & ~(out["proc_icb"] | out["proc_ncb"])
    out["proc_n_modalities"] = sum((f.cast("int") for f in out.values()), F.lit(0))
    return out


def foreign_currency(c: Column, local: Sequence[str] = LOCAL_CURRENCY) -> Column:
    """False if a local-currency word is there, else true; null for null."""
    return ~F.lower(c).rlike("|".join(local))


def commodity_sector(c: Column, words: Sequence[str] = COMMODITY_SECTORS) -> Column:
    """Substring match, so "oil" is also found in "soil"; false for null."""
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
