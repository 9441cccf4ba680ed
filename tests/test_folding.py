"""Folding of many texts at once, groups read as a stream, and heads looked for by hash."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone import catalog, session
from quillstone.functions import text as t
from quillstone.operators import extraction, pages, resolve, retrieval, runs
from quillstone.plans import stats

ODD = "aBzZ09 .,\n\tñÑßüİıΣσς½№ﬁ…ÅＡª²™가힣̧́ͅ🙂𝐀 \x85ǅΐ\x00"


def words(text):
    return re.sub("[^a-z0-9]+", " ", t.fold(text)).strip(" ")


@pytest.mark.parametrize("piece", [1 << 18, 300, 20])
@pytest.mark.parametrize("left_out", ["", "Σ"])
def test_many_texts_are_folded_as_each_alone(monkeypatch, piece, left_out):
    monkeypatch.setattr(t, "PIECE", piece)
    some = random.Random(piece)
    alphabet = "".join(c for c in ODD if c not in left_out) + "abc DE " * 4
    texts = [None if some.random() < 0.1 else "".join(some.choices(alphabet, k=some.choice([0, 1, 3, 30, 200]))) for _ in range(300)]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(7, 90), pa.array([], pa.string()), pa.array([None], pa.string())):
        plain = column.to_pylist()
        assert t._folded(column).to_pylist() == [None if x is None else t.fold(x) for x in plain]
        assert t._worded(column).to_pylist() == [None if x is None else words(x) for x in plain]


def test_texts_are_not_folded_one_by_one(monkeypatch):
    """fold is asked once a character that was not met before, not once a text."""
    asked = []
    monkeypatch.setattr(t, "fold", lambda x, real=t.fold: asked.append(x) or real(x))
    assert t._folded(pa.array([f"Costo y Financiación {i} ½" for i in range(1000)])).to_pylist()[7] == "costo y financiacion 7 1⁄2"
    assert len(asked) <= 2


def test_contents_lines(spark):
    lines = ["a ..... 7", "a .... 7", "…… 3", "… 3", "_____9", "____9", "..... x", "", None, ".... ____ … 5"]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, text string").select("i", t.is_contents_line(F.col("text")).alias("c"))
    assert [r.c for r in got.orderBy("i").collect()] == [bool(x and re.search(t.CONTENTS_LINE, x)) for x in lines]


@pytest.mark.parametrize("scanned", [0, 1 << 20])
def test_heads_are_found_by_hash_and_by_scan(monkeypatch, scanned):
    monkeypatch.setattr(resolve, "SCANNED", scanned)
    some = random.Random(scanned)
    for _ in range(60):
        bag = ["aa", "b", "abc", "quick", "a"][: some.choice([1, 2, 5])]
        by_doc = {f"d{i}": {" ".join(some.choices(bag, k=some.choice([0, 5, 40, 200]))) for _ in range(3)} for i in range(some.choice([1, 4]))}
        texts = [w for each in by_doc.values() for w in each]
        heads = {h for w in texts for k in (0, 3) for n in (25, 120) if len(h := w[k : k + n]) >= 25} | {"q" * 30}
        assert sorted(resolve._found(heads, by_doc)) == sorted((h, d) for h in heads for d, each in by_doc.items() if any(h in w for w in each))


def test_groups_may_be_cut_by_batches():
    rows = [(1, "a"), (1, "b"), (2, "c"), (2, None), (2, "d"), (3, "e")]
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([v for _, v in rows])], names=["k", "v"])
    for size in (1, 2, 4, 6):
        cut = (whole.slice(i, size) for i in range(0, len(rows), size))
        assert [(k, g["v"]) for _, k, g in runs.groups(cut, "k")] == [(1, ["a", "b"]), (2, ["c", None, "d"]), (3, ["e"])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_operations_are_not_grouped_one_a_call(spark):
    """heads and texts of many operations are a task's stream of batches."""
    calls = spark.createDataFrame([(1, "the rights of the borrower under this loan")], "operation long, head string")
    blocks = spark.createDataFrame([(1, "d", "all the rights of the borrower under this loan end")], "operation long, doc string, words string")
    hits = resolve.quote_hits(calls, blocks)
    assert "FlatMapCoGroups" not in plan(hits)
    assert [tuple(r) for r in hits.collect()] == [(1, "the rights of the borrower under this loan", "d")]


def test_one_call_chooses_for_many_operations(spark, monkeypatch):
    """operations share calls of the grouped function, each with its own budget."""
    monkeypatch.setattr(retrieval, "GROUPS", 1)
    rows = [(o, d, p, ["works"], {"works": 1}, [], True, False, f"chunk {o} {d} {p}", 26 + 14 * (o == 2)) for o in range(3) for d in range(2) for p in range(3)]
    shape = "operation long, doc_idx int, pos int, tags array<string>, hits map<string,int>, doc_hints array<string>, numbered boolean, pinned boolean, chunk string, budget int"
    chosen = retrieval.across_documents(spark.createDataFrame(rows, shape), "operation", "budget")
    assert sorted(tuple(r)[:3] for r in chosen.collect()) == [(o, 0, p) for o in range(3) for p in range(3 if o == 2 else 2)]


def test_tags_are_made_once(spark):
    """a filter on tags does not fold and search every text again."""
    rows = spark.createDataFrame([(1, "a loan currency"), (2, "....... 5 loan currency"), (3, None), (4, "other")], "pos long, text string")
    found = retrieval.tagged(rows).filter(F.size("tags") > 0)
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("ArrowEvalPython") == 1 and shown.lower().count("contains") < 2 * sum(map(len, t.KEYWORDS.values()))
    assert [(r.pos, r.tags, r.low) for r in found.collect()] == [(1, ["financing"], "a loan currency")]


def test_python_gets_few_bytes_at_a_time(spark, tmp_path, monkeypatch):
    """rows are long, and a session made elsewhere has a large bound; a task has
    one Python worker with one small batch."""
    text = F.repeat(F.lit("a mention "), 400)
    spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda table, needed=False: kept.append(table) or table)
    monkeypatch.setattr(t, "_folded", lambda texts: pa.array([f"tion {texts.nbytes}"] * len(texts)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")  # Spark's default
    try:
        catalog.tag_rank(spark, str(tmp_path))
        assert plan(kept[0]).count("ArrowEvalPython") == 1
        sizes = kept[0].select(F.regexp_extract("low", r"\d+", 0).cast("long").alias("size"))
        assert sizes.agg(F.count("*").alias("n"), F.max("size").alias("most")).filter("n = 3000 AND most BETWEEN 100000 AND 5000000").count() == 1
    finally:
        session.small_batches(spark)


def test_excerpts_are_made_once(spark, monkeypatch):
    """F8: blocks and calls read stored excerpts."""
    kept = []
    monkeypatch.setattr(extraction, "stored", lambda table, needed=False: kept.append(table.columns) or table)
    bundles = spark.createDataFrame([("a", "[d ¶1.1, p.1] the works of this operation are many"), ("b", "")], "operation string, bundle string")
    done = spark.createDataFrame([("b", True)], "operation string, complete boolean")
    rows = extraction.run_pending(bundles, done, extraction.keyword_extractor({"goods_share_pct": "works"})).collect()
    assert ["operation", "bundle"] in kept and [(r.operation, r.status, r.source_document) for r in rows] == [("a", "found", "d")]


def test_an_audit_is_made_once(spark):
    """no part of the diagnosis makes the audit's rows again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def status(i):
        made.add(1)
        return ("found", "not_stated")[i % 2]

    numbers = ("n_paragraphs_total", "n_paragraphs_relevant", "bundle_chars", "n_documents_failed")
    field = F.struct(F.lit("a").alias("field"), status("id").alias("status"))
    audit = spark.range(6).select(F.concat(F.lit("JA-"), F.col("id")).alias("operation"), F.struct(*[F.col("id").alias(n) for n in numbers]).alias("stats"), F.array(field).alias("fields"))
    parts = stats.diagnose(audit)
    assert [tuple(r) for r in parts["status"].collect()] == [("a", 3, 0, 3, 50.0)]
    assert parts["health"].first().n_ops == 6 and parts["quantiles"].count() == 3 and parts["language"].first().found_per_op == 0.5
    assert made.value == 6


def test_pages_are_read_once_where_they_are(spark):
    """one pass makes a page's text, and none of its lines is shuffled."""
    listed = ["https://x.org/1", "Loan proposal", "a.pdf", "May 1", "English"]
    texts = ["\n".join(x) for x in (["top", "Country", "", " Peru", *listed, *listed[:4]], ["Country", "", *listed, "", "Country", "Chile"], listed[:4], ["x", "Country"], [])]
    html = spark.createDataFrame([(i, f"<p>{x.replace(chr(10), '</p><p>')}</p>") for i, x in enumerate(texts)] + [(9, None)], "page_id long, html string")
    found = pages.page_fields(html.select("page_id", pages.html_to_text(F.col("html")).alias("text")))
    assert plan(found).count("ArrowEvalPython") == 1 and "Exchange" not in plan(found)
    rows = {r.page_id: (r.country, r.docs and [tuple(d) for d in r.docs]) for r in found.collect()}
    doc = ("https://x.org/1", "a.pdf", "May 1", "English")
    assert rows == {0: ("Peru", [doc]), 1: ("https://x.org/1", [doc]), 2: ("", None), 3: ("", None), 4: ("", None), 9: ("", None)}
    plain = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    assert [tuple(r) for r in pages.listed_documents(plain).orderBy("page_id").collect()] == [(0, 4, *doc), (1, 2, *doc)]
    assert [r.country for r in pages.labelled_values(plain).orderBy("page_id").collect()] == ["Peru", "https://x.org/1", "", "", ""]
