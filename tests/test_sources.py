"""Readers, document files, batches and incremental runs."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quillstone.operators import batch
from quillstone.sources import documents, tables
from quillstone.streaming import resume


def word_file(*lines):
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    folder = tmp_path / "AR-L1"
    folder.mkdir()
    (folder / "b.docx").write_bytes(word_file("1.1 One", "two"))
    (folder / "a").write_bytes(word_file("sniffed"))
    (folder / "c.PDF").write_bytes(b"%PDF-1.4")
    (folder / "d.docx").write_bytes(b"broken")
    (folder / "e.txt").write_bytes(b"no")
    (folder / "f.pdf").write_bytes(b"x" * 2000)
    files = documents.read_files(spark, str(tmp_path), max_bytes=1500)
    got = {r["doc_name"]: (r["operation"], r["kind"], r["doc_idx"]) for r in files.collect()}
    assert got == {"a": ("AR-L1", "docx", 0), "b.docx": ("AR-L1", "docx", 1), "c.PDF": ("AR-L1", "pdf", 2), "d.docx": ("AR-L1", "docx", 3), "f.pdf": ("AR-L1", "too_large", 4)}
    rows = documents.read_word(files).collect()
    assert {(r["doc_name"], r["text"]) for r in rows if r["error"] is None} == {("a", "sniffed"), ("b.docx", "1.1 One"), ("b.docx", "two")}
    assert [r["doc_name"] for r in rows if r["error"]] == ["d.docx"]
    assert documents.pdf_pages(b"", [lambda c: [" "], lambda c: ["text"]]) == ["text"]


def test_contents_are_in_no_shuffle_and_unreadable_files_are_rows(spark, tmp_path):
    folder = tmp_path / "AR-L1"
    folder.mkdir()
    (folder / "long title.pd").write_bytes(b"%PDF" + b"x" * 3000)
    (folder / "zip").write_bytes(word_file("y" * 9000, *(str(i) * 40 for i in range(300))))
    (folder / "ok.pdf").write_bytes(b"%PDF ok")
    (folder / "gone.pdf").write_bytes(b"%PDF gone")
    (folder / "lost.pdf").symlink_to(folder / "nowhere")
    (folder / "sheet.zip").write_bytes(b"PK\x03\x04broken")
    (folder / "lost.pdf").unlink()
    listed = documents.list_files(spark, str(tmp_path), max_bytes=1000, attempts=2, delay=0.01)
    assert "content" not in listed.columns
    kinds = {r["doc_name"]: r["kind"] for r in listed.collect()}
    assert kinds == {"long title.pd": "too_large", "zip": "too_large", "ok.pdf": "pdf", "gone.pdf": "pdf"}
    (folder / "gone.pdf").unlink()  # after it was listed
    read = documents.read_contents(listed, attempts=2, delay=0.01, task_bytes=4)
    got = {r["doc_name"]: r for r in read.collect()}
    assert bytes(got["ok.pdf"]["content"]) == b"%PDF ok" and got["gone.pdf"]["kind"] == "unreadable" and "gone.pdf" in got["gone.pdf"]["error"]
    assert [r["doc_name"] for r in documents.unreadable(read).collect()] == ["gone.pdf"]
    paras, notes = documents.project_paragraphs(read, [lambda c: ["2.1 text"]])
    assert paras.count() == 1 and {r["note"].split("]")[0][1:] for r in notes.collect()} == {"long title.pd", "zip", "gone.pdf"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # what is dealt is the list


def test_attempts_wait_and_give_up():
    from quillstone.sources.store import attempted

    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "read"

    assert attempted(flaky, 3, 0.001) == "read" and len(tries) == 3
    tries.clear()
    try:
        attempted(flaky, 2, 0.001)
    except OSError as e:
        assert str(e) == "not yet" and len(tries) == 2


def test_folder_to_bundle(spark, tmp_path):
    """Files of two kinds, an unreadable and a too large one, to one excerpt."""
    from quillstone.operators import extraction, retrieval

    folder = tmp_path / "AR-L1"
    folder.mkdir()
    (folder / "a.docx").write_bytes(word_file("1.1 The executing agency", "plans procurement"))
    (folder / "b.pdf").write_bytes(b"%PDF 2.1 Civil works begin")
    (folder / "c.docx").write_bytes(b"broken")
    (folder / "d.pdf").write_bytes(b"x" * 3000)
    files = documents.read_files(spark, str(tmp_path), max_bytes=2000)
    paras, notes = documents.project_paragraphs(files, [lambda c: [c.decode()[5:]]])
    bundle = retrieval.project_bundle(paras, "operation", notes).first()["bundle"]
    assert "[a.docx ¶1.1, p.n/a] The executing agency plans procurement" in bundle and "[b.pdf ¶2.1, p.1] Civil works begin" in bundle
    assert bundle.startswith("[c.docx] -- could not parse") and "[d.pdf] -- skipped, 0 MB exceeds the 40 MB parsing limit" in bundle
    calls = extraction.extract_document(paras.filter("doc_idx = 1"), extraction.keyword_extractor({"civil_works_type": "civil works"}))
    assert [(r["status"], r["citation_para"]) for r in calls.collect()] == [("found", "b.pdf ¶2.1, p.1")]


def test_sinks(spark, tmp_path):
    from quillstone.sources import sinks

    path = str(tmp_path / "t")
    for ids in (range(3), range(1, 5)):
        sinks.append_new(spark.createDataFrame([(i,) for i in ids], "k int"), path, "k")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    sinks.write_log(spark.createDataFrame([("AR-L1", True)], "operation_number string, eligible boolean"), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).columns == list(sinks.LOG_COLUMNS)
    sheet = sinks.review_sheet(spark.createDataFrame([(1,), (2,)], "k int")).withColumn("hand_coded_value", F.when(F.col("k") == 1, " x "))
    assert [r["k"] for r in sinks.reviewed(sheet).collect()] == [1] and sinks.glossary(spark).count() == 17


def test_transactions_and_panel(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Transaction type,Amount,Year,Month,Operation number\nDISBURSEMENT,5,2000,2,AR0001\nDISBURSEMENT,bad,2000,3,AR0001\nREPAYMENT,9,1999,1,AR0001\nDISBURSEMENT,1,,3,AR0001\nDISBURSEMENT,7,2000,1,\n")
    flows = tables.load_transactions(spark, str(tmp_path / "t.csv"))
    assert {tuple(r) for r in tables.monthly_flows(flows).withColumn("amount", F.col("amount").cast("int")).collect()} == {("AR0001", 2000, 2, 5), ("AR0001", 2000, 3, 0), ("", 2000, 1, 7)}
    assert {tuple(r) for r in tables.earliest_flow(flows).collect()} == {("AR0001", 1999, 1), ("", 2000, 1)}
    (tmp_path / "p.csv").write_text("operation_number,x\nCO-L1234,not stated\nlegend,y\nAR0001,val\n")
    assert {tuple(r) for r in tables.load_panel(spark, str(tmp_path / "p.csv")).collect()} == {("CO-L1234", None), ("AR0001", "val")}


def test_bulk_and_splice_inputs(spark, tmp_path):
    from quillstone.plans import enrich

    (tmp_path / "b.csv").write_text(
        "Project Number,Country,Funding Source,Approval Amount,Total Cost,Status,Approval Date\nAR-L1234,Peru,KIF-x,2500000,9000000,ACTIVE,2001-02-03\nAR-L1234,Chile,ORC-y,5000000,1,EXITED,2001-02-03\n,Peru,,,,,\nZZ-T1,Peru,,bad,,,2001-01-01\n"
    )
    bulk = tables.load_bulk(spark, str(tmp_path / "b.csv"))
    assert "lending_type" not in bulk.columns and [r[0] for r in enrich.candidates(bulk, 2000, 2002).collect()] == ["AR-L1234"]
    r = {x["operation"]: x for x in enrich.bulk_metadata(bulk.withColumn("lending_type", F.lit(None).cast("string"))).collect()}["AR-L1234"]
    assert (r["own_musd"], r["cofinancing_musd"], r["counterpart_musd"], r["cofinancing_agency"], r["country_iso3"], r["bulk_status"]) == (5.0, 2.5, 1.5, "KIF-x", "PER", "Active")
    (tmp_path / "a.csv").write_text("OPER_NUM,FRST_ELIG_DT,Amount_Approved,DISB_25_DT,DISB_50_DT,DISB_75_DT\nA,05jan2001,10,2001m7,,x\nA,01feb2002,99,,,\n")
    a = tables.load_approved(spark, str(tmp_path / "a.csv")).collect()
    assert len(a) == 1 and (str(a[0]["eligible"]), int(a[0]["approved"]), str(a[0]["t25"]), a[0]["t50"]) == ("2001-01-05", 10, "2001-07-01", None)


def test_dates_series_audit(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Operation number,First disbursement date,Totally disbursed date,Current disbursement expiration date\n A ,2001-02-03,,x\nA,1999-01-01,,\n,2000-01-01,,\n")
    r = tables.load_dates(spark, str(tmp_path / "d.csv")).collect()
    assert len(r) == 1 and str(r[0]["first_disbursement"]) == "2001-02-01" and r[0]["expiration"] is None
    (tmp_path / "s.csv").write_text("DATE,ABC\n2000-01-01,1.5\n2000-01-02,.\n")
    assert [x["value"] for x in tables.load_series(spark, str(tmp_path / "s.csv"), "ABC").orderBy("date").collect()] == [1.5, None]
    assert tables.load_calendar(spark, str(tmp_path / "no.csv"), "year int, month int").count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"A": {"stats": {"n_documents": 1}, "fields": [{"field": "x", "status": "found"}, {"field": None}]}, "B": {"stats": {}, "fields": []}}))
    audit = tables.load_audit(spark, str(tmp_path / "a.json"))
    assert audit.count() == 2 and [x["sampleable"] for x in tables.audit_calls(audit).orderBy("call_id").collect()] == [True, False]
    assert tables.rename(spark.createDataFrame([("1",)], "a string"), {"a": "b", "c": "d"}).first().asDict() == {"b": "1", "d": None}


def test_header_search(spark):
    sheet = [("notes", 0, 0, "Date of issue"), ("data", 0, 0, "Title"), ("data", 3, 1, "Ref date"), ("data", 3, 2, "GSCPI value"), ("data", 4, 1, "2000-01-31"), ("data", 4, 2, "0.5"), ("data", 5, 1, "2000-02-29"), ("data", 5, 2, "n/a")]
    cells = spark.createDataFrame(sheet, "sheet string, row int, col int, text string")
    head = tables.find_header(cells, "date", "gscpi")
    assert tuple(head.first()) == ("data", 3, 1, 2)
    assert [(str(r["date"]), r["value"]) for r in tables.sheet_series(cells, head, "g").orderBy("date").collect()] == [("2000-01-31", 0.5), ("2000-02-29", None)]


def test_batch_is_first_fit_by_name(spark):
    sizes = spark.createDataFrame([("c", 5), ("a", 6), ("b", 7), ("d", 1)], "operation string, bytes long")
    got = [r["operation"] for r in batch.plan_batch(sizes, free_gb=12 / 2**30, margin=1.0).collect()]
    assert got == ["a", "c", "d"]


def test_incremental_run(spark, tmp_path):
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    run = lambda: resume.process_new_files(spark, src, "id long", sink, str(tmp_path / "cp"), lambda df: df.withColumn("y", F.col("id") * 2), "id", 1)
    spark.range(5).write.parquet(src)
    run()
    spark.range(3, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(8))


def test_stream_windows(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = resume.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == resume.windowed_counts(e).count()
