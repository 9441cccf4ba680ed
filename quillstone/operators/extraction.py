"""The extraction step: prompt, a pluggable extractor, and resuming."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.values import DESCRIPTIONS, FIELDS, STATUSES
from ..session import stored
from . import resolve

RULES = (
    "Use only what the excerpt says.",
    "Call the tool once for every field.",
    f"Status is one of {', '.join(STATUSES)}: found needs a verbatim quote, stated_absent an explicit denial, and not_stated has a null value.",
    "Copy the citation exactly as it stands in the brackets.",
    "Text about another, an earlier or a parent operation is no evidence for this one.",
    "A contents line, heading or title is no evidence.",
)
CALL = "operation string, call_id int, field string, value string, status string, citation_para string, quote string, reason string, dropped string"

#: (operation, bundle) -> calls, each a mapping with the names of CALL.
Extractor = Callable[[str, str], list[Mapping]]


def prompt(operation: Column, bundle: Column, fields: Mapping[str, str] = FIELDS) -> Column:
    """The request for one operation."""
    listed = "\n".join(f"- {name} ({kind}): {DESCRIPTIONS.get(name, '')}" for name, kind in fields.items())
    head = "Extract structured data about operation "
    rules = "\n".join(f"- {r}" for r in RULES)
    return F.concat(F.lit(head), operation.cast("string"), F.lit(f".\nRules:\n{rules}\nFields:\n{listed}\nExcerpt:\n---\n"), bundle, F.lit("\n---\n"))


def keyword_extractor(terms: Mapping[str, str]) -> Extractor:
    """A deterministic stand-in for a model: a field is found in the first block
    that holds its term, and that block is the quote."""

    def extract(operation: str, bundle: str) -> list[Mapping]:
        blocks = [b.strip() for b in bundle.split("\n\n")]
        lows = [fold(b) for b in blocks]
        calls = []
        for field, term in terms.items():
            sought = fold(term)
            hit = next((b for b, low in zip(blocks, lows) if sought in low), None)
            mark = re.match(r"^\[([^\]]*)\] ?", hit or "")
            quote = (hit or "")[mark.end() :] if mark else ""
            calls.append({"field": field, "value": term if hit else None, "status": "found" if hit else "not_stated", "citation_para": mark.group(1) if mark else "", "quote": quote})
        return calls

    return extract


def extract(bundles: DataFrame, extractor: Extractor) -> DataFrame:
    """Calls of all operations. bundles: operation, bundle. A failing extractor
    gives one call with the error as its status, to be run again. What is no mapping, or
    has no field, stays as a call with the reason and what it was instead."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CALL.split(", ")]
        for part in parts:
            rows = []
            for operation, bundle in zip(part["operation"], part["bundle"]):
                try:
                    calls = extractor(operation, bundle or "")
                except Exception as e:  # noqa: BLE001  the row is kept for a retry
                    calls = [{"status": f"api_call_failed: {e}"}]
                for i, call in enumerate(calls):
                    reason = dropped = None
                    if not isinstance(call, Mapping):
                        reason, dropped, call = "not an object", repr(call)[:200], {}
                    elif call.get("field") is None and not str(call.get("status", "")).startswith("api_call_failed"):
                        reason, dropped = "no field", ", ".join(sorted(map(str, call))[:12])
                    value = call.get("value")
                    shown = value if value is None or isinstance(value, str) else json.dumps(value)
                    field = call.get("field")
                    rows.append([operation, i, None if field is None else str(field), shown, call.get("status"), call.get("citation_para"), call.get("quote"), reason, dropped])
            yield pd.DataFrame(rows, columns=names)

    return bundles.select(F.col("operation").cast("string").alias("operation"), "bundle").mapInPandas(run, CALL)


def extract_document(paragraphs: DataFrame, extractor: Extractor, budget: int = 12_000) -> DataFrame:
    """Calls for single documents: tags, the best tagged paragraphs of each with their
    whole texts under the document budget, then the extractor. paragraphs: operation,
    pos, para_id, page, text; doc_name, if there is one, stands in the citation."""
    from . import retrieval

    rows = retrieval.tagged(paragraphs).filter(F.size("tags") > 0)
    place = F.concat(F.lit("¶"), F.col("para_id"))
    place = F.concat(F.col("doc_name"), F.lit(" "), place) if "doc_name" in paragraphs.columns else place
    rows = rows.withColumn("chunk", F.concat(F.lit("["), place, F.lit(", p."), F.col("page"), F.lit("] "), F.col("text")))
    picked = retrieval.by_score(stored(rows.select("operation", "pos", "score", "chunk"), needed=True), "operation", budget)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "\n\n")
    return extract(picked.groupBy("operation").agg(body.alias("bundle")), extractor)


def run_pending(bundles: DataFrame, entries: DataFrame, extractor: Extractor) -> DataFrame:
    """Calls of the operations without a complete entry, with their sources."""
    # Excerpts are read for their blocks and for their calls, and made once.
    todo = stored(resolve.pending(bundles, entries), needed=True)
    blocks, calls = stored(resolve.blocks_of(todo)), stored(extract(todo, extractor))
    hits = stored(resolve.quote_hits(calls, blocks))
    return resolve.contamination(resolve.resolve(calls, blocks, hits=hits), blocks, hits=hits)
