"""Queries of the training-data operators, and the SQL twins of those that SQL
can express."""

from __future__ import annotations

from . import cohorts, exact_dedup, fill_middle
from .ann import op9_ann
from .best_fit import op11_best_fit
from .byte_bpe import op7_byte_bpe
from .cohorts import op12_cohort_retention
from .exact_dedup import op2_exact_dedup
from .fill_middle import op13_fill_middle
from .language_id import op1_language_id
from .near_dedup import op6_near_dedup
from .packing import op4_packing
from .pii import op10_pii
from .token_files import op8_token_files
from .toxicity import op3_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_files": op8_token_files,
    "op9_ann": op9_ann,
    "op10_pii": op10_pii,
    "op11_best_fit": op11_best_fit,
    "op12_cohort_retention": op12_cohort_retention,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op12_cohort_retention": cohorts.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
