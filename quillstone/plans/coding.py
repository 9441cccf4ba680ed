"""Free-text fields coded to classes and flags, with their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coding as c


def code_free_text(panel: DataFrame, key: str = "operation") -> DataFrame:
    """panel: key, executing_agency_type, fx_denomination, procurement_modality."""
    t = panel.select(key, c.stated(F.col("executing_agency_type")).alias("agency"), c.stated(F.col("fx_denomination")).alias("fx"), c.stated(F.col("procurement_modality")).alias("proc"))
    agency = F.col("agency")
    return t.select(
        key, c.agency_level(agency).alias("agency_level"), c.agency_form(agency).alias("agency_form"), c.newly_created(agency).alias("agency_newly_created"),
        *[x.alias(n) for n, x in c.flags(F.col("fx"), c.CURRENCY).items()], *[x.alias(n) for n, x in c.procurement_flags(F.col("proc")).items()], "agency", "fx", "proc",
    )


def unmatched(coded: DataFrame, key: str = "operation") -> DataFrame:
    """Stated texts that no pattern places: check, key, text."""
    no_fx = ~reduce(lambda a, b: a | b, [F.col(n) for n in c.CURRENCY])
    checks = (
        ("agency_form=other", F.col("agency_form") == "other", "agency"), ("agency_level not stated", F.col("agency_level") == "level_not_stated", "agency"),
        ("fx: no flag set", F.col("fx").isNotNull() & no_fx, "fx"), ("procurement: no flag set", F.col("proc").isNotNull() & (F.col("proc_n_modalities") == 0), "proc"),
    )
    # One pass: each row lists the checks it fails.
    failed = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("check"), F.col(text).alias("raw_value"))) for name, cond, text in checks]))
    return coded.select(key, F.explode(failed).alias("f")).select(F.col("f.check").alias("check"), key, F.col("f.raw_value").alias("raw_value"))
