"""Text functions, paragraphs, retrieval and resolution."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import coding, keys, months, text as t, values as v
from quillstone.operators import extraction, pages, paragraphs, resolve, retrieval
from quillstone.plans import coding as code_plan


def one(spark, *columns, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} {'string' if isinstance(x, str) or x is None else 'int'}" for k, x in data.items()))
    return df.select(*columns).first()


def test_keys(spark):
    rows = [("AR0058", True, True, True), ("CO-L1234", True, True, False), ("XX1234", False, False, False), (" br-t1092 ", True, False, False), (None, False, False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "k string")
    got = df.select(keys.is_operation(F.col("k")), keys.is_loan(F.col("k")), keys.is_old_scheme(F.col("k"))).collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]
    assert one(spark, keys.keys_in(F.col("s")), s="co-l1234, EN1234, AR0058 and CO-L1234")[0] == ["CO-L1234", "AR0058"]


def test_fold_and_tags(spark):
    assert t.fold("Licitación PÚBLICA ﬁn") == "licitacion publica fin"
    df = spark.createDataFrame([("Licitación pública internacional; moneda",), ("procurement ..... 12",), (None,)], "text string")
    got = retrieval.tagged(df).select("tags", "score").collect()
    assert sorted(got[0]["tags"]) == ["financing", "procurement"] and got[0]["score"] == 2
    assert got[1]["tags"] == [] and got[2]["tags"] == []


def test_window(spark):
    text = "x" * 3000 + " counterpart " + "y" * 3000
    low = F.col("text")
    got = one(spark, t.window(low, low, F.array(F.lit("financing"))), text=text)[0]
    assert got == "[...] " + text[2601:5101] + " [...]"
    assert one(spark, t.window(low, low, F.array(F.lit("financing"))), text="short")[0] == "short"
    assert one(spark, t.window(low, low, F.array(F.lit("works"))), text=text)[0] == text[:2500] + " [...]"


def test_citation(spark):
    f = lambda s: one(spark, t.cited_paragraph(F.col("c")), c=s)[0]
    assert f("[Loan.pdf ¶2.9, p.21]") == "2.9" and f("page-6, p.6") == "page-6" and f(None) == ""


def test_months(spark):
    f = lambda s: one(spark, months.coded_month(F.col("c")).cast("string"), c=s)[0]
    assert f("1999m7") == "1999-07-01" and f("1999m13") is None and f("x") is None
    assert one(spark, months.month_of_cell(F.col("c")).cast("string"), c="2001-02-17 00:00")[0] == "2001-02-01"


def test_cells(spark):
    f = lambda s, k: one(spark, v.cell(F.col("c"), k), c=s)[0]
    assert f("YES", "boolean or null") == "true" and f("maybe", "boolean") == "maybe" and f("nan", "string") is None
    assert f("12.50", "number or null") == "12.5" and f("n/a", "number or null") == "n/a"
    g = lambda s: one(spark, v.comparable(F.col("c"), "number or null"), c=s)[0]
    assert g("1,234.567%") == "1234.57" and g("Text") == "text"


def test_terminal_state(spark):
    rows = [("Cancelled", None, "cancelled"), ("Closed", "Active", "disbursed_complete"), ("Implementation", None, "still_active"), ("odd", "Active", "still_active"), (None, None, "unknown"), ("closed", None, "unknown")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r[0] for r in df.select(v.terminal_state(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]


def test_coding(spark):
    rows = [("x", "Unit, not newly created", "Dólares", "International Competitive Bidding"), ("y", "Ministério da Fazenda", "moneda local", "competitive bidding"), ("z", "Not stated", None, "")]
    got = code_plan.code_free_text(spark.createDataFrame(rows, "operation string, executing_agency_type string, fx_denomination string, procurement_modality string"))
    r = {x["operation"]: x for x in got.collect()}
    # "national competitive bidding" is found inside "international ..." too.
    assert r["x"]["agency_newly_created"] is True and r["x"]["proc_icb"] and not r["x"]["proc_bidding_unspecified"] and r["x"]["proc_ncb"] and r["x"]["proc_n_modalities"] == 2 and r["x"]["fx_usd"]
    assert r["y"]["agency_level"] == "national" and r["y"]["agency_form"] == "ministry_or_secretariat" and r["y"]["proc_bidding_unspecified"] and r["y"]["fx_local_currency_option"]
    assert r["z"]["agency_level"] is None and r["z"]["fx_usd"] is None and r["z"]["proc_n_modalities"] is None
    checks = {(c["check"], c["operation"]) for c in code_plan.unmatched(got).collect()}
    assert ("agency_level not stated", "x") in checks and not any(op == "z" for _, op in checks)
    assert one(spark, coding.commodity_sector(F.col("c")), c=None)[0] is False and one(spark, coding.foreign_currency(F.col("c")), c=None)[0] is None


def model_segments(pages_):
    """The rule of the pages, line by line."""
    out, open_ = [], None
    for number, text in pages_:
        any_ = False
        for raw in text.split("\n"):
            line = raw.strip()
            m = re.match(r"^(\d{1,2}\.\d{1,2})\s+(.*)", line)
            if m:
                any_ = True
                if open_:
                    out.append(open_)
                open_ = [m.group(1), str(number), [m.group(2)]]
            elif open_:
                open_[2].append(line)
        if not any_ and text.strip():
            out.append([f"page-{number}", str(number), [text.strip()[:4000]]])
    if open_:
        out.append(open_)
    return [(a, b, " ".join(c)) for a, b, c in out]


def test_segments(spark):
    docs = {
        1: [(1, "Cover\npage"), (2, "1.1 First\nmore\n\n1.2 Second"), (3, "no number\nhere"), (4, "  "), (5, "1.3 Third\n2.10 Fourth")],
        2: [(1, "nothing numbered"), (2, "still nothing")],
        3: [(1, "1.1 a\n1.2 b"), (2, "")],
        4: [(1, "")],
    }
    df = spark.createDataFrame([(k, n, x) for k, ps in docs.items() for n, x in ps], "doc_id long, page int, text string")
    got = {}
    for r in paragraphs.segment_pages(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["para_id"], r["page"], r["text"]))
    assert got == {k: m for k, ps in docs.items() if (m := model_segments(ps))}


def test_word_segments(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Title", "", "Intro", "1.1 First", "more", "1.2 Second"])], "doc_id long, at int, text string")
    got = [(r["para_id"], r["page"], r["text"]) for r in paragraphs.segment_word_paragraphs(df).orderBy("pos").collect()]
    assert got == [("docx-p1", "n/a", "Title"), ("docx-p2", "n/a", "Intro"), ("1.1", "n/a", "First more"), ("1.2", "n/a", "Second")]


@given(st.lists(st.integers(1, 50), max_size=30), st.integers(0, 200), st.data())
@settings(max_examples=200, deadline=None)
def test_round_robin_keeps_the_budget(sizes, budget, data):
    tags = ["a", "b", "c"]
    queues = {x: data.draw(st.permutations(range(len(sizes)))) for x in tags}
    pinned = [data.draw(st.integers(0, len(sizes) - 1))] if sizes else []
    chosen = retrieval.round_robin(queues, sizes, pinned, budget, ("b",))
    used = sum(sizes[i] + 2 for i in chosen)
    assert used <= budget and chosen == sorted(set(chosen))
    # Nothing that was left out would still fit.
    assert all(used + n + 2 > budget for i, n in enumerate(sizes) if i not in chosen)


def test_round_robin_order():
    sizes = [10, 10, 10, 10]
    assert retrieval.round_robin({"works": [0, 1], "risks": [2, 3]}, sizes, [], 36) == [0, 1, 2]
    assert retrieval.round_robin({"works": [0, 1], "risks": [2, 3]}, sizes, [3], 24) == [0, 3]
    assert retrieval.round_robin({"works": [0]}, [100], [], 50) == []


def test_by_score_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0, 1, "a" * 5), (1, 1, 3, "b" * 8), (1, 2, 2, "c" * 9), (1, 3, 1, "d" * 2)], "k int, pos int, score int, chunk string")
    assert [r["pos"] for r in retrieval.by_score(df, "k", 15).collect()] == [0, 1, 3]
    assert [r["pos"] for r in retrieval.in_document_order(df, "k", 14).collect()] == [0, 1]


def paras(spark):
    rows = [
        ("AR-L1", 0, "Loan AR-L1.pdf", 0, "page-1", "1", "TERMS Financial Terms and Conditions " + "z" * 50),
        ("AR-L1", 0, "Loan AR-L1.pdf", 1, "2.1", "2", "The executing agency keeps a procurement plan for all civil works of this operation"),
        ("AR-L1", 1, "annex.pdf", 0, "page-1", "1", "Elsewhere BR0216 had price adjustment clauses in its supply contracts at that time"),
        ("AR-L1", 1, "annex.pdf", 1, "page-2", "2", "nothing here"),
    ]
    return spark.createDataFrame(rows, "operation string, doc_idx int, doc_name string, pos int, para_id string, page string, text string")


def test_bundle_and_resolution(spark):
    b = retrieval.project_bundle(paras(spark), "operation").first()
    assert b["n_total"] == 4 and b["n_relevant"] == 3 and b["bundle"].count("\n\n") == 2
    notes = spark.createDataFrame([("AR-L1", 0, "[big.pdf] skipped")], "operation string, note_idx int, note string")
    small = retrieval.project_bundle(paras(spark), "operation", notes, budget=150).first()
    assert small["bundle"].startswith("[big.pdf] skipped\n\n") and len(small["bundle"]) <= 150
    bundles = spark.createDataFrame([("AR-L1", b["bundle"])], "operation string, bundle string")
    blocks = resolve.blocks_of(bundles)
    assert blocks.count() == 3
    long_quote = "Elsewhere BR0216 had price adjustment clauses"
    calls = spark.createDataFrame(
        [("AR-L1", 1, long_quote, "x", "found"), ("AR-L1", 2, "short", "Loan AR-L1.pdf ¶2.1, p.2", "found"), ("AR-L1", 3, "", "page-1, p.1", "found"), ("AR-L1", 4, "q" * 30, None, "not_stated")],
        "operation string, call_id int, quote string, citation_para string, status string",
    )
    found = resolve.resolve(calls, blocks)
    assert {r["call_id"]: r["source_document"] for r in found.collect()} == {1: "annex.pdf", 2: "Loan AR-L1.pdf", 3: "", 4: ""}
    flagged = resolve.contamination(found, blocks)
    f = {r["call_id"]: r for r in flagged.collect()}
    assert not f[1]["source_names_operation"] and f[1]["other_operations_in_quote"] == ["BR0216"] and f[2]["source_names_operation"]
    assert tuple(resolve.quality_counters(flagged).first()) == ("AR-L1", 1, 2)


def test_calls_to_panel_and_completeness(spark):
    calls = spark.createDataFrame([("a", 0, "x", "1"), ("a", 1, "x", "2"), ("a", 2, "odd", "3"), ("a", 3, None, "4"), ("b", 0, "odd", "5")], "operation string, call_id int, field string, value string")
    got = {r["operation"]: r["x"] for r in resolve.calls_to_panel(calls, fields=["x", "y"]).collect()}
    assert got == {"a": "2", "b": None}
    e = "operation string, n_paragraphs int, n_failed int, bundle_chars int, dry_run boolean, api_failed boolean, fields array<string>"
    rows = [("ok", 5, 1, 9, False, False, ["x", "y"]), ("unread", 0, 1, 0, False, False, []), ("dry", 1, 0, 1, True, False, ["x", "y"]), ("api", 1, 0, 1, False, True, ["x", "y"]), ("empty", 1, 0, 7, False, False, []), ("stale", 1, 0, 1, False, False, ["x"]), ("nothing", 1, 0, 0, None, None, None)]
    done = resolve.stale_or_failed(spark.createDataFrame(rows, e), ["x", "y"])
    assert {r["operation"] for r in done.filter("complete").collect()} == {"ok", "nothing"}
    folders = spark.createDataFrame([("ok",), ("stale",), ("new",)], "operation string")
    assert {r[0] for r in resolve.pending(folders, done).collect()} == {"stale", "new"}


def test_extraction_keeps_failures(spark):
    bundles = spark.createDataFrame([("a", "[f.pdf ¶1.1, p.1] civil works ahead"), ("b", "x")], "operation string, bundle string")

    def flaky(op, bundle):
        if op == "b":
            raise RuntimeError("no answer")
        return extraction.keyword_extractor({"civil_works_type": "civil works"})(op, bundle)

    got = {r["operation"]: r for r in extraction.extract(bundles, flaky).collect()}
    assert got["a"]["status"] == "found" and got["a"]["citation_para"] == "f.pdf ¶1.1, p.1" and got["b"]["status"].startswith("api_call_failed")
    assert "civil works ahead" in bundles.select(extraction.prompt(F.col("operation"), F.col("bundle"))).first()[0]


def test_page_fields(spark):
    html = "<html><head><title>P</title><script>Country</script></head><body><div>Country</div><p>Peru</p><div>Approval Date</div><p>May 2, 2001</p>" + "".join(
        f"<div>https://x.example/{i}</div><div>{c}</div><div>f{i}.pdf</div><div>May 1</div><div>English</div>" for i, c in enumerate(("Loan Proposal", "Annex", "LOAN PROPOSAL"))
    ) + "</body></html>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").select("page_id", pages.html_to_text(F.col("html")).alias("text"))
    got = {r["page_id"]: r for r in pages.page_fields(df).collect()}
    assert got[1]["country"] == "Peru" and got[1]["project_status"] == "" and [x["filename"] for x in got[1]["docs"]] == ["f0.pdf", "f2.pdf"] and got[2]["docs"] is None
    name = spark.createDataFrame([("é" * 100 + ".pdf",)], "n string").select(pages.safe_file_name(F.col("n"))).first()[0]
    assert name.endswith(".pdf") and len(name.encode()) <= 150
