"""Personal data: patterns, and terms that reveal a protected value.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and telephone
numbers. Information-theoretic sanitisation adds spans: the protected values are
the base matches; a term's disclosure of a value e is PMI(t; e) / IC(e), with the
probabilities counted over the whole corpus (distinct texts with the term, distinct
contexts with the value, distinct contexts of the value with the term near it).
It is the share of e's information that the term alone gives away. Terms at
``remove_at`` or more are removed, terms at ``generalise_at`` or more are replaced
by their length class. Copies of one context count once. A term that stands in
fewer than ``min_contexts`` distinct contexts of the value counts by a lower bound:
of its contexts, the share that the Wilson bound (``z``) grants to so few. So
values seen once or twice are scored too, with less certainty.

Positions come without any per-row code: the pieces between matches, from a split
by the same pattern, and a running sum of lengths. Patterns use possessive
quantifiers, which match the same strings as the greedy ones here but need neither
backtracking nor deep stacks on long runs.

Built of DataFrame functions only.

Defined results: a null text counts as empty and has no spans; rows that repeat an
id are judged each for itself; other columns are ignored by the finder and kept by
the sanitiser; an empty table gives no rows. Where spans overlap, the sanitiser
replaces their union by the first one's mark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import BROADCAST_IDS, Scratch, only_ids, without_ids

KINDS = ("email", "ip", "card", "phone")
#: A match starts where a run of its characters starts, or where the match before
#: it ended: all other starts inside a run fail alike, so they are not tried.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
#: Characters of context on each side of a value.
CONTEXT = 96


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the sanitisation."""

    generalise_at: float = 0.8
    remove_at: float = 0.95
    min_contexts: int = 3
    z: float = 1.96


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    padded = F.lpad(_digits(m), 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.ascii(F.substring(padded, i, 1)) - 48
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if i % 2 == 0 else d)
    return total % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """Whether a match of the pattern counts."""
    if kind == "ip":
        # All parts without leading zeros are at most 255.
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a document with its matches in order: gap before it, length, value,
    context. Texts without a match that counts have none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    none = F.array().cast("array<string>")
    t = t.select("*", *[F.when(F.col("text").rlike(SIGNS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in KINDS])
    t = t.select("*", *[F.when(F.exists(f"m_{k}", partial(_holds, k)), F.split("text", PATTERNS[k], -1)).alias(f"p_{k}") for k in KINDS])

    def spans(order: int, kind: str) -> Column:
        pieces = F.col(f"p_{kind}")
        every = F.transform(
            f"m_{kind}",
            lambda m, i: F.struct(
                F.lit(order).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("length"), _holds(kind, m).alias("holds"), m.alias("value"),
                F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(pieces, i + 1), 1, CONTEXT).alias("right"),
            ),
        )
        return F.when(pieces.isNotNull(), every).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,holds:boolean,value:string,left:string,right:string>>"))

    return t.select("row", "doc_id", "text_key", F.concat(*[spans(i, k) for i, k in enumerate(KINDS)]).alias("found"))


def _base(marks: DataFrame) -> DataFrame:
    """The matches that count, with their positions in code points."""
    each = marks.filter(F.size("found") > 0).select("row", "doc_id", "text_key", F.explode("found").alias("m")).select("row", "doc_id", "text_key", "m.*")
    past = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(past))
    return each.filter("holds").select("row", "doc_id", "text_key", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value", "left", "right")


def _co_occurrence(base: DataFrame, n_docs: float, disclosure: Disclosure) -> DataFrame:
    """(value, term, n_both, n_value) for terms near a value.

    The distinct texts whose contexts hold a term are a lower bound of all texts
    with it. Pairs that miss the threshold even with this bound are left out here,
    so common words are never looked up in the corpus.
    """
    # A word cut by the context's edge, or grown together with a value, is no term.
    left = F.when(F.length("left") == CONTEXT, F.regexp_replace("left", r"^\S+", "")).otherwise(F.col("left"))
    right = F.when(F.length("right") == CONTEXT, F.regexp_replace("right", r"\S+$", "")).otherwise(F.col("right"))
    words = F.lower(F.concat_ws(" ", F.regexp_replace(left, r"\p{L}+$", ""), F.regexp_replace(right, r"^\p{L}+", "")))
    found = base.select("text_key", F.lower("value").alias("value"), F.xxhash64("left", "right").alias("context"), F.array_distinct(F.regexp_extract_all(words, F.lit(TERM), F.lit(0))).alias("terms"))
    least = found.select("text_key", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    near = found.groupBy("value", "context").agg(F.min("terms").alias("terms"))
    both = near.select("value", F.explode("terms").alias("term")).groupBy("value", "term").agg(F.count("*").alias("n_both"))
    pairs = both.join(near.groupBy("value").agg(F.count("*").alias("n_value")), "value").join(least, "term")
    return pairs.filter(_share(n_docs, disclosure) >= disclosure.generalise_at).drop("n_term")


def _share(n_docs: float, disclosure: Disclosure) -> Column:
    """PMI(term; value) / IC(value), by a lower bound of the joint count if it is small."""
    information = F.log2(F.lit(max(n_docs, 2.0)) / F.col("n_value"))
    lost = F.log2(F.greatest(F.col("n_term"), F.col("n_both")) / F.col("n_both"))
    sure = F.col("n_both") / (F.col("n_both") + disclosure.z**2)
    lost = F.when(F.col("n_both") < disclosure.min_contexts, lost - F.log2(sure)).otherwise(lost)
    return F.when(information > 0, (information - lost) / information).otherwise(F.lit(0.0))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


#: Bytes of a table of terms that is broadcast at most.
BROADCAST_BYTES = 64 << 20


def _checked(side: DataFrame) -> DataFrame:
    """Broadcast a stored table of terms only if it is small, in rows and in bytes."""
    size = side.limit(BROADCAST_IDS + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(side) if size["rows"] <= BROADCAST_IDS and size["bytes"] <= BROADCAST_BYTES else side


def revealing_terms(docs: DataFrame, texts: DataFrame, base: DataFrame, scratch: Scratch, disclosure: Disclosure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, disclosure): the largest share of a value's information that the
    term gives away, for terms over the threshold; texts: the text_key of every row."""
    # Copies count once, as the contexts do.
    n_docs = float(texts.agg(F.count_distinct("text_key")).first()[0])
    pairs = scratch.write(_co_occurrence(base, n_docs, disclosure), "pairs")
    terms = scratch.write(pairs.select("term").distinct(), "terms")
    words = _words(docs, id_col, text_col).select(F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
    with_term = scratch.write(words.join(_checked(terms), "term").distinct().groupBy("term").agg(F.count("*").alias("n_term")), "with_term")
    return scratch.write(pairs.join(with_term, "term").groupBy("term").agg(F.max(_share(n_docs, disclosure)).alias("disclosure")).filter(F.col("disclosure") >= disclosure.generalise_at), "revealing")


def _term_spans(docs: DataFrame, revealing: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Every occurrence of the revealing terms: doc_id, text_key, start, end, disclosure."""
    t = _words(docs, id_col, text_col)
    word = t.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
    ids = scratch.write(word.join(_checked(revealing.select("term")), "term", "left_semi").select("doc_id").distinct(), "term_ids")
    some = only_ids(t, ids).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("m"), F.split("text", TERM, -1).alias("p"))
    each = some.select("row", "doc_id", "text_key", F.posexplode(F.arrays_zip("m", "p")).alias("i", "x")).filter("x.m is not null")
    past = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.length("x.p") + F.length("x.m")).over(past))
    named = each.select("doc_id", "text_key", (F.col("end") - F.length("x.m")).alias("start"), "end", F.lower("x.m").alias("term"))
    return named.join(revealing, "term").select("doc_id", "text_key", "start", "end", "disclosure").distinct()


def find_personal_data(docs: DataFrame, *, disclosure: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_key and spans, an array of (start, kind,
    end, mark) by start and kind; kinds 0 to 3 are KINDS, 4 is a term."""
    scratch = Scratch(docs.sparkSession, "pii")
    marks = scratch.write(_marks(docs, id_col, text_col), "marks")
    base = scratch.write(_base(marks), "base")
    spans = base.select("row", F.struct("start", "kind", "end", F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]")).alias("mark")).alias("span"))
    revealing = revealing_terms(docs, marks.select("text_key"), base, scratch, disclosure, id_col, text_col)
    if revealing.limit(1).count():
        found = scratch.write(_term_spans(docs, revealing, scratch, id_col, text_col), "term_spans")
        mark = F.when(F.col("disclosure") >= disclosure.remove_at, F.lit("[TERM]")).otherwise(F.concat(F.lit("[TERM-"), F.when(F.col("end") - F.col("start") > 6, "LONG").otherwise("SHORT"), F.lit("]")))
        rows = marks.select("row", "doc_id", "text_key")
        terms = found.join(rows, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])).select("row", "start", "end", F.struct("start", F.lit(4).alias("kind"), "end", mark.alias("mark")).alias("span"))
        inside = base.select(F.col("row").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
        free = terms.join(inside, (F.col("row") == F.col("b_row")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")), "left_anti")
        spans = spans.unionByName(free.select("row", "span"))
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,mark:string>>")
    return marks.select("row", "doc_id", "text_key").join(grouped, "row", "left").select("doc_id", "text_key", F.coalesce("spans", empty).alias("spans"))


def sanitise(docs: DataFrame, *, disclosure: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span of personal data replaced by its mark."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    found = find_personal_data(docs, disclosure=disclosure, id_col=id_col, text_col=text_col).filter(F.size("spans") > 0)
    found = scratch.write(found.select(F.col("doc_id").alias("__pii_id"), F.col("text_key").alias("__pii_key"), F.col("spans").alias("__pii_spans")).dropDuplicates(["__pii_id", "__pii_key"]), "found")
    ids = scratch.write(found.select("__pii_id").distinct(), "ids")
    hit = only_ids(docs, ids, id_col).withColumn("__pii_text_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    hit = hit.join(found, hit[id_col].eqNullSafe(F.col("__pii_id")) & (F.col("__pii_text_key") == F.col("__pii_key")), "left")
    # Four bytes a code point: pieces are cut without counting from the start.
    wide = F.encode(F.col(text_col).cast("string"), "UTF-32")
    spans = F.col("__pii_spans")
    reach = F.aggregate(
        spans, F.array().cast("array<struct<start:bigint,end:bigint,mark:string>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"), F.element_at(done, -1)["mark"].alias("mark")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["mark"].alias("mark"))))),
    )
    hit = hit.withColumn("__pii_wide", wide).withColumn("__pii_apart", reach)

    def cut(begin: Column, end: Column) -> Column:
        return F.decode(F.substring(F.col("__pii_wide"), (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")), "UTF-32")

    apart = F.col("__pii_apart")
    before = F.transform(apart, lambda s, i: F.concat(cut(F.when(i > 0, F.get(apart, i - 1)["end"]).otherwise(F.lit(0)), s["start"]), s["mark"]))
    tail = cut(F.element_at(apart, -1)["end"], F.octet_length("__pii_wide") / 4)
    hit = hit.withColumn(text_col, F.when(F.size("__pii_spans") > 0, F.concat(F.array_join(before, ""), tail)).otherwise(F.col(text_col)))
    return without_ids(docs, ids, id_col).unionByName(hit.select(*docs.columns))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, (*KINDS, "term")))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] < 4)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")))
