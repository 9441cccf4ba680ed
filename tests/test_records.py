"""One file read by many tasks equals one read by Python."""

import csv
import json
import random

import pytest

from quillstone.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "4096")
    spark.conf.set(names[1], "1")
    yield
    for n, x in before.items():
        spark.conf.set(n, x) if x is not None else spark.conf.unset(n)


def cell(rng):
    return "".join(rng.choice(['"', "\n", ",", "a", "é", " ", "\r\n", "日", "x,y", '""']) for _ in range(rng.randint(0, 12)))


def test_csv_equals_the_module(spark, tmp_path, small_blocks):
    """Quoted line ends, quotes, commas, blank lines, and cells longer than blocks."""
    rng = random.Random(7)
    rows = [["key", "x\ny", "key", ""]] + [[f"k{i % 50}", cell(rng), cell(rng), "z"] for i in range(3000)]
    rows[700][1], rows[701][2] = "line\n" * 3000, '"' * 9000 + "\n,"
    with open(tmp_path / "a.csv", "w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        for i, row in enumerate(rows):
            writer.writerow(row)
            if i % 200 == 9:
                f.write("\n")
    with open(tmp_path / "a.csv", newline="") as f:
        want = [r for r in csv.reader(f) if r]
    assert want == rows
    out = records.csv_rows(spark, str(tmp_path / "a.csv"))
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    got = [r["cells"] for r in out.orderBy("file", "block", "nth").collect()]
    assert got == want
    table = tables.placed_text_table(spark, str(tmp_path / "a.csv"))
    assert table.columns == ["key", "x\ny", "key.1", "_c3", tables.PLACE]
    assert [list(r)[:4] for r in table.orderBy(tables.PLACE).collect()] == want[1:]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_csv_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿k,v\r\n1,\"a\r\nb\"\r\n2\r\n3,4,5\r\n".encode())
    assert [tuple(r) for r in tables.read_text_table(spark, str(tmp_path / "a.csv")).orderBy("k").collect()] == [("1", "a\r\nb"), ("2", ""), ("3", "4")]
    (tmp_path / "b.csv").write_text("k,v\n1,\"never ends\nhere")
    assert [tuple(r) for r in tables.read_text_table(spark, str(tmp_path / "b.csv")).collect()] == [("1", "never ends\nhere")]
    (tmp_path / "c.csv").write_text("k,v\n")
    assert tables.read_text_table(spark, str(tmp_path / "c.csv")).count() == 0
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"k,v\n{i},\"x\n{i}\"\n")
    assert sorted(tuple(r) for r in tables.read_text_table(spark, str(folder)).collect()) == [(str(i), f"x\n{i}") for i in range(3)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_map_equals_the_module(spark, tmp_path, small_blocks, indent):
    """Braces, quotes and backslashes in strings, deep values, an entry longer than blocks."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(['"', "}", "{", "\\", "\n", "a", "é", ",", ":"]) for _ in range(rng.randint(0, 30)))
    audit = {f"op{i}{text()}": {"stats": {"n_documents": i}, "fields": [{"field": text(), "value": text(), "status": "found", "quote": text()} for _ in range(rng.randint(0, 4))]} for i in range(800)}
    audit["long"] = {"stats": {}, "fields": [{"field": "}" * 30_000, "value": "\\" * 30_000}]}
    (tmp_path / "a.json").write_text(json.dumps(audit, indent=indent, ensure_ascii=False))
    got = {r["operation"]: r for r in tables.load_audit(spark, str(tmp_path / "a.json")).collect()}
    assert set(got) == set(audit)
    for k, e in audit.items():
        assert [(f["field"], f["value"], f["quote"]) for f in got[k]["fields"]] == [(f["field"], f["value"], f.get("quote")) for f in e["fields"]]
        assert got[k]["stats"]["n_documents"] == e["stats"].get("n_documents")


def test_json_odd_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}\n")
    assert tables.load_audit(spark, str(tmp_path / "a.json")).count() == 0
    (tmp_path / "b.json").write_text('{"a": null, "b": {"stats": {}}, "c": {"stats": {"n_documents": 2}}}')
    assert {r["operation"] for r in tables.load_audit(spark, str(tmp_path / "b.json")).collect()} == {"a", "b", "c"}
