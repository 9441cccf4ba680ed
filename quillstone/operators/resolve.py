"""Quotes to source documents, contamination flags, and calls to a panel."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text as t
from ..functions.values import FIELDS
from ..session import stored
from .runs import by_key

MIN_QUOTE, QUOTE_HEAD = 25, 120
#: Characters of an operation's blocks and heads that one task compares as they are;
#: larger operations are looked up in the index.
AT_ONCE = 1 << 19
#: Heads times characters up to which they are looked for one by one.
SCANNED = 1 << 20


def blocks_of(bundles: DataFrame, key: str = "operation", bundle: str = "bundle") -> DataFrame:
    """The marked blocks of each excerpt: key, block, doc, para, words.

    An excerpt is cut at blank lines, so text after one inside a paragraph has no
    mark and belongs to no block. White space of any kind around a block does not hide
    its mark; the block's text begins as many characters into it as the mark is long."""
    rows = bundles.select(key, F.posexplode(F.split(bundle, "\n\n")).alias("block", "raw")).filter(F.contains("raw", F.lit("¶")))
    # The mark is looked for once; its parts are told from it.
    rows = rows.withColumn("mark", F.regexp_extract(t.stripped(F.col("raw")), t.MARK, 0)).filter("mark <> ''")
    file, para, _ = t.marked(F.col("mark"))
    body = F.expr("substring(raw, length(mark) + 1)")
    return rows.select(key, "block", file.alias("doc"), para.alias("para"), t.words_of(body).alias("words"))


def id_index(blocks: DataFrame, key: str = "operation") -> DataFrame:
    """Paragraph ids that stand in exactly one document: key, para, id_doc."""
    found = blocks.groupBy(key, "para").agg(F.min("doc").alias("id_doc"), F.max("doc").alias("high"))
    return found.filter("id_doc = high").select(key, "para", "id_doc")


def _quoted(calls: DataFrame) -> DataFrame:
    if "head" in calls.columns:
        return calls
    words = t.words_of(F.coalesce("quote", F.lit("")))
    return calls.withColumn("q", words).withColumn("head", F.when(F.length("q") >= MIN_QUOTE, F.substring("q", 1, QUOTE_HEAD)))


def _others(key: str, prefixes: Sequence[str]) -> Column:
    return F.array_sort(F.array_remove(keys.keys_in(F.coalesce("quote", F.lit("")), prefixes), F.upper(F.col(key).cast("string"))))


def noted(calls: DataFrame, key: str = "operation", prefixes: Sequence[str] = keys.COUNTRY_PREFIXES) -> DataFrame:
    """calls with what resolution and flags need of their quotes (head, and others: the
    operations that the quote names beside its own) in place of the quotes, so that no
    quote is in a shuffle."""
    return _quoted(calls.withColumn("others", _others(key, prefixes))).drop("quote", "q")


def grams_of(words: Column, shortest: int = MIN_QUOTE) -> Column:
    """The fingerprints of a text: of every ``shortest`` characters in a row, at least one
    is a fingerprint of any text that holds them (winnowing). A gram is a hash of the
    first half of so many characters, a fingerprint the least of the grams that begin in
    the second half. Shorter texts have none."""
    gram = (shortest + 1) // 2
    windows = shortest + 1 - gram

    def prints(column: pa.Array) -> pa.Array:
        _, places, data = column.buffers()
        n = len(column)
        at = np.frombuffer(places, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        if len(raw) < shortest:
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array(np.empty(0, np.int64)))
        grams = np.zeros(len(raw) - gram + 1, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + raw[k : len(grams) + k]
        grams ^= grams >> np.uint64(31)
        least = np.lib.stride_tricks.sliding_window_view(grams, windows).min(1)
        # Windows that begin in a text and end in it.
        text = np.repeat(np.arange(n), np.diff(at))[: len(least)]
        inside = np.arange(len(least)) + shortest <= at[text + 1]
        text, least = text[inside], least[inside]
        order = np.lexsort((least, text))
        text, least = text[order], least[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
        sizes = np.bincount(text[new], minlength=n)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(least[new].view(np.int64)))

    return F.arrow_udf(prints, "array<bigint>")(F.coalesce(words, F.lit("")))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many bytes, from those of shorter runs."""
    done, out, part, width, power = 0, None, data.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while done < size:
        if size & width:
            out = part if out is None else out[: len(part) - done] * np.uint64(power) + part[done:]
            done += width
        if done < size:
            part = part[:-width] * np.uint64(power) + part[width:]
            width, power = 2 * width, power * power % 2**64
    return out


def _found(heads: set[str], by_doc: Mapping[str, set[str]]) -> list[tuple[str, str]]:
    """Which heads are in which document's texts.

    Texts are laid end to end. Heads hold no line ends, so none is found across two. Where
    heads and text are many, the places where a head may begin are told by a hash."""
    pieces = ["\n".join(words).encode() for words in by_doc.values()]
    ends = np.cumsum([len(p) + 1 for p in pieces]).tolist()
    text, docs = b"\n".join(pieces), list(by_doc)
    found: list[tuple[str, str]] = []

    def search(head: str) -> None:
        sought = head.encode()
        at = text.find(sought)
        while at >= 0:
            k = bisect_right(ends, at)
            found.append((head, docs[k]))
            at = text.find(sought, ends[k])

    shortest = min((len(h.encode()) for h in heads), default=0)
    if shortest < 8 or 2 * shortest > len(text) or len(heads) * len(text) < SCANNED:
        for head in heads:
            search(head)
        return found
    alike: dict[bytes, list[str]] = {}
    for head in heads:
        alike.setdefault(head.encode()[:shortest], []).append(head)
    starts = _hashes(np.frombuffer(b"".join(alike), np.uint8), shortest)[::shortest]
    order = np.argsort(starts)
    there = _hashes(np.frombuffer(text, np.uint8), shortest)
    nearest = np.minimum(np.searchsorted(starts[order], there), len(order) - 1)
    at = np.flatnonzero(starts[order][nearest] == there)
    by_start = np.argsort(nearest[at], kind="stable")
    at, which = at[by_start], nearest[at][by_start]
    edges = np.searchsorted(which, np.arange(len(order) + 1)).tolist()
    listed, same_start = at.tolist(), list(alike.values())
    for k, i in enumerate(order.tolist()):
        places = listed[edges[k] : edges[k + 1]]
        for head in same_start[i]:
            # Boilerplate: many places for many heads.
            if len(places) > 64:
                search(head)
            else:
                sought = head.encode()
                found += [(head, doc) for doc in {docs[bisect_right(ends, p)] for p in places if text.startswith(sought, p)}]
    return found


def _compared(heads: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hits of operations of which one task can hold all: each head is looked for in the
    operation's texts."""

    def find(rows: dict[str, list]) -> list[tuple]:
        asked, by_doc = set(), {}
        for head, doc, words in zip(rows["head"], rows["doc"], rows["words"]):
            if head is not None:
                asked.add(head)
            elif words is not None:
                by_doc.setdefault(doc, set()).add(words)
        return _found(asked, by_doc) if asked and by_doc else []

    none = F.lit(None).cast("string")
    both = heads.select(key, "head", none.alias("doc"), none.alias("words")).unionByName(texts.select(key, none.alias("head"), "doc", "words"))
    return by_key(both, key, find, ["head", "doc"])


def _looked_up(heads: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Hits of operations of any size.

    The blocks' fingerprints are an inverted index. A block that holds a head has all
    fingerprints of the head, so each head asks for its rarest one in its operation, and a
    head with a fingerprint that no block has is in none. What the index returns is
    compared as text. Equal heads ask once, and a document's equal blocks answer once."""
    asked = heads.select(key, "head").distinct().withColumn("grams", grams_of(F.col("head")))
    texts = stored(blocks.select(key, "doc", "words").distinct().withColumn("text", F.xxhash64("doc", "words")).withColumn("grams", grams_of(F.col("words"))))
    index = texts.select(key, "text", F.explode("grams").alias("gram"))
    often = index.groupBy(key, "gram").agg(F.count("*").alias("often"))
    asks = asked.select(key, "head", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(often, [key, "gram"])
    rarest = asks.groupBy(key, "head", "all").agg(F.count("*").alias("there"), F.min_by("gram", "often").alias("gram")).filter(F.col("there") == F.col("all"))
    found = rarest.select(key, "head", "gram").join(index, [key, "gram"]).select(key, "text", "head")
    return found.join(texts.select(key, "text", "doc", "words"), [key, "text"]).filter(F.contains("words", F.col("head"))).select(key, "head", "doc").distinct()


def quote_hits(calls: DataFrame, blocks: DataFrame, key: str = "operation") -> DataFrame:
    """Which documents hold the heads of which quotes: key, head, doc, each once.

    Most operations are small: a task compares all heads and texts of one at once, and
    nothing but these is dealt out. Of those beyond AT_ONCE characters no task holds the
    whole; an index finds the texts that a head is compared with. calls and blocks are
    read several times and should be stored."""
    heads = _quoted(calls).filter(F.col("head").isNotNull() & F.col(key).isNotNull())
    sizes = blocks.select(key, F.length("words").alias("n")).unionByName(heads.select(key, F.length("head").alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))
    large = stored(sizes.filter(F.col("n") > AT_ONCE).select(key))
    if large.isEmpty():
        return _compared(heads, blocks, key)
    small = _compared(heads.join(large, key, "left_anti"), blocks.join(large, key, "left_anti"), key)
    return small.unionByName(_looked_up(heads.join(large, key, "left_semi"), blocks.join(large, key, "left_semi"), key))


def resolve(calls: DataFrame, blocks: DataFrame, key: str = "operation", call: str = "call_id", hits: DataFrame | None = None) -> DataFrame:
    """calls with source_document: the one document whose block holds the quote's
    head; else the document of its paragraph id, if that is unique; else ''. hits: those
    of quote_hits, where they are known already."""
    hits = quote_hits(calls, blocks, key) if hits is None else hits
    one = hits.groupBy(key, "head").agg(F.min("doc").alias("quote_doc"), F.max("doc").alias("high")).filter("quote_doc = high").select(key, "head", "quote_doc")
    cited = _quoted(calls).withColumn("para", t.cited_paragraph(F.col("citation_para")))
    out = cited.join(one, [key, "head"], "left").join(id_index(blocks, key), [key, "para"], "left")
    return out.withColumn("source_document", F.coalesce("quote_doc", "id_doc", F.lit(""))).select(*calls.columns, "source_document")


def contamination(resolved: DataFrame, blocks: DataFrame, key: str = "operation", call: str = "call_id", prefixes: Sequence[str] = keys.COUNTRY_PREFIXES, hits: DataFrame | None = None) -> DataFrame:
    """Adds source_names_operation and other_operations_in_quote.

    named: the operation stands in the file's name, or (without its hyphen) in the
    text of the source document's blocks, all blocks if the source is unknown; that is
    told once a document. others: other operations in the quote, if a block of the source
    (or any) holds the quote. Both are null for calls that are not found."""
    hits = quote_hits(resolved, blocks, key) if hits is None else hits
    bare = F.replace(F.upper(F.col(key).cast("string")), F.lit("-"), F.lit(""))
    squeezed = F.replace(F.upper("words"), F.lit(" "), F.lit(""))
    by_doc = blocks.groupBy(key, "doc").agg(F.bool_or(F.contains(squeezed, bare)).alias("in_text"))
    # The empty name stands for all documents of the operation.
    named = by_doc.unionByName(by_doc.groupBy(key).agg(F.bool_or("in_text").alias("in_text")).withColumn("doc", F.lit("")))
    there = hits.unionByName(hits.select(key, "head").distinct().withColumn("doc", F.lit(""))).withColumn("quote_there", F.lit(True))
    out = _quoted(resolved).join(named.withColumnRenamed("doc", "source_document"), [key, "source_document"], "left")
    out = out.join(there.withColumnRenamed("doc", "source_document"), [key, "head", "source_document"], "left")
    others = F.col("others") if "others" in resolved.columns else _others(key, prefixes)
    in_name = F.contains(F.upper("source_document"), F.upper(F.col(key).cast("string")))
    found = F.col("status") == "found"
    names = F.when(found, in_name | F.coalesce("in_text", F.lit(False)))
    listed = F.when(found, F.when(F.coalesce("quote_there", F.lit(False)), others).otherwise(F.array().cast("array<string>")))
    return out.select(*resolved.columns, names.alias("source_names_operation"), listed.alias("other_operations_in_quote"))


def quality_counters(flagged: DataFrame, key: str = "operation") -> DataFrame:
    """Found values without a source, and values whose source is doubtful."""
    doubtful = ~F.col("source_names_operation") | (F.size("other_operations_in_quote") > 0)
    return flagged.groupBy(key).agg(F.count_if((F.col("status") == "found") & (F.col("source_document") == "")).alias("citations_unresolved"), F.count_if((F.col("status") == "found") & doubtful).alias("values_from_unnamed_source"))


def checked_calls(calls: DataFrame, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """calls with the reason a call is malformed, or null, and what was dropped. A bad
    call loses its value, never the operation's row. A reason that the extraction gave
    (what came was no object) stays."""
    given = [F.col(c) if c in calls.columns else F.lit(None).cast("string") for c in ("reason", "dropped")]
    unknown = ~F.col("field").isin(*fields)
    reason = F.when(F.col("field").isNull(), "no field").when(unknown, "unknown field")
    return calls.withColumns({"reason": F.coalesce(given[0], reason), "dropped": F.coalesce(given[1], F.when(unknown, F.substring("field", 1, 80)))})


def calls_to_panel(calls: DataFrame, key: str = "operation", order: str = "call_id", fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """One row an operation, a column a field; the last call of a field counts."""
    good = checked_calls(calls, fields)
    last = [F.max_by(F.col("value"), F.when(F.col("field") == f, F.col(order))).alias(f) for f in fields]
    return good.groupBy(key).agg(*last)


def stale_or_failed(entries: DataFrame, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """entries (key, n_paragraphs, n_failed, bundle_chars, dry_run, api_failed,
    fields ARRAY<STRING>) with complete: none of five reasons to run it again."""
    missing = F.array_except(F.array(*map(F.lit, fields)), F.coalesce("fields", F.array().cast("array<string>")))
    unread = (F.coalesce("n_failed", F.lit(0)) > 0) & (F.coalesce("n_paragraphs", F.lit(0)) == 0)
    nothing = (F.size(F.coalesce("fields", F.array().cast("array<string>"))) == 0) & (F.coalesce("bundle_chars", F.lit(0)) > 0)
    some = F.size(F.coalesce("fields", F.array().cast("array<string>"))) > 0
    again = unread | F.coalesce("dry_run", F.lit(False)) | F.coalesce("api_failed", F.lit(False)) | nothing | (some & (F.size(missing) > 0))
    return entries.withColumn("complete", ~again)


def pending(folders: DataFrame, entries: DataFrame, key: str = "operation") -> DataFrame:
    """Folders without a complete entry."""
    return folders.join(entries.filter("complete").select(key), key, "left_anti")
