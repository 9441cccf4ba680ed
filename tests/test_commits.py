"""Batches that are run again, fail half-way, or find a large log."""

import pytest
from pyspark.sql import functions as F

from quillstone.sources import commits
from quillstone.sources.commits import KeyLog


def ids(spark, *ranges):
    return spark.createDataFrame([(f"k{i}", i) for r in ranges for i in r], "k string, v long")


def held(spark, path):
    return sorted((r["v"], r["batch"]) for r in commits.committed(spark, path).collect())


def test_batches_and_growth(spark, tmp_path):
    path = str(tmp_path / "t")
    log = KeyLog(spark, path, "k", rows=2)
    assert log.append(ids(spark, range(30), range(30))) == 30 and log.folders() == 16
    assert log.append(ids(spark, range(20, 70))) == 40 and log.folders() == 64  # 70 keys: more than two a folder
    assert log.append(ids(spark, range(70))) == 0
    assert log.append(ids(spark, range(200, 210)), batch=1) == 0  # done before
    assert held(spark, path) == [(i, 0 if i < 30 else 1) for i in range(70)]
    assert log.commits() == {0: 30, 1: 40, 2: 0}
    assert spark.read.parquet(path).count() == 70  # the log is no part of the table


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    log = KeyLog(spark, path, "k")
    log.append(ids(spark, range(10)), batch=0)
    with monkeypatch.context() as m:
        m.setattr(log, "_touch", lambda name: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.append(ids(spark, range(5, 20)), batch=1)
    assert held(spark, path) == [(i, 0) for i in range(10)]  # rows and keys are there, the mark is not
    assert log.append(ids(spark, range(5, 18)), batch=1) == 8
    assert held(spark, path) == [(i, 0 if i < 10 else 1) for i in range(18)]


def test_a_batch_reads_its_own_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    log = KeyLog(spark, path, "k")
    log.append(ids(spark, range(300)))
    some = ids(spark, [3, 900])
    left = log.unseen(some, 7)
    assert [r["v"] for r in left.collect()] == [900]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1]
    assert log.append(spark.createDataFrame([(None, 1), (None, 2)], "k string, v long")) == 1
