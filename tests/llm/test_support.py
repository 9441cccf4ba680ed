"""Scratch tables: where they lie, and when they go."""

import os
from types import SimpleNamespace

import pytest

from quillstone.llm import support as su


def folder_of(scratch):
    return scratch.root.removeprefix("file://")


def test_scratches_are_freed(spark):
    with su.freeing():
        a = su.Scratch(spark, "a")
        t = a.write(spark.range(5), "t")
        with su.freeing():
            b = su.Scratch(spark, "b")
            b.write(spark.range(5), "t")
        assert t.count() == 5 and os.path.isdir(folder_of(a)) and not os.path.isdir(folder_of(b))
    assert not os.path.isdir(folder_of(a))
    c = su.Scratch(spark, "c")
    kept, gone = c.write(spark.range(5), "kept"), c.write(spark.range(5), "gone")
    c.drop(gone)
    assert kept.count() == 5 and len(os.listdir(folder_of(c))) == 1
    c.close()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_only_its_own_tables_are_dropped(spark, tmp_path, monkeypatch, scheme):
    """Whether or not the shared folder is named with a scheme, a table that lies
    elsewhere is refused and stays, also one beside the scratch."""
    monkeypatch.setattr(su, "shared_dir", lambda _: f"{scheme}{tmp_path}/shared %20 folder")
    scratch = su.Scratch(spark, "own")
    own = scratch.write(spark.range(3), "own")
    for place in (tmp_path / "input" / "documents.parquet", tmp_path / "shared %20 folder" / "quillstone" / "other"):
        spark.range(5).write.parquet(str(place))
        foreign = spark.read.parquet(str(place))
        for frames in ((foreign,), (own, foreign)):
            with pytest.raises(ValueError, match="not a table of this scratch"):
                scratch.drop(*frames)
        assert foreign.count() == 5 and own.count() == 3
    scratch.drop(own)
    assert not os.listdir(folder_of(scratch))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_the_pipeline_leaves_its_input(spark, tmp_path, monkeypatch, scheme):
    import corpus_pipeline as cp

    monkeypatch.setattr(su, "shared_dir", lambda _: f"{scheme}{tmp_path}/shared")
    monkeypatch.setattr(cp, "STAGES", [("a", lambda s, d, _: d), ("b", lambda s, d, _: d), ("c", lambda s, d, _: d)])
    folder = tmp_path / "tables"
    for name in ("documents", "labels"):
        spark.range(7).write.parquet(f"{folder}/{name}.parquet")
    assert cp.run(spark, str(folder)).count() == 7
    assert sorted(os.listdir(folder)) == ["documents.parquet", "labels.parquet"] and spark.read.parquet(f"{folder}/documents.parquet").count() == 7


def test_no_local_folder_on_a_cluster():
    """Without a shared folder a cluster's session is an error."""
    none = SimpleNamespace(isDefined=lambda: False)
    given = SimpleNamespace(isDefined=lambda: True, get=lambda: "hdfs://x/y/")

    def fake(found, master):
        context = SimpleNamespace(master=master, applicationId="app", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        su.shared_dir(fake(none, "spark://a:7077"))
    assert su.shared_dir(fake(given, "spark://a:7077")) == "hdfs://x/y"
