"""The greedy choice on sizes equals one over all candidates, and its groups stay small."""

import random

from pyspark.sql import functions as F

from quillstone.operators import retrieval as r

SHAPE = "operation string, doc_idx int, pos int, tags array<string>, hits map<string,int>, doc_hints array<string>, numbered boolean, pinned boolean, chunk string"


def candidates(rng, op, n, sizes):
    rows = []
    for i in range(n):
        tags = rng.sample(["works", "risks", "zeta", "financing"], rng.randint(0, 3))
        rows.append((op, i % 5, i, tags, {t: rng.randint(1, 4) for t in tags}, rng.sample(["works", "risks"], rng.randint(0, 1)), rng.random() < 0.5, rng.random() < 0.1 or not tags, "x" * rng.choice(sizes)))
    return rows


def brute(rows, budget):
    """All candidates of one operation in their queues, without pruning."""
    rows = sorted(rows, key=lambda x: (x[1], x[2]))
    queues = {}
    for i, x in enumerate(rows):
        for t in x[3]:
            queues.setdefault(t, []).append(((t not in x[5], -x[4][t], not x[6], x[1], x[2]), i))
    queues = {t: [i for _, i in sorted(q)] for t, q in queues.items()}
    chosen = r.round_robin(queues, [len(x[8]) for x in rows], [i for i, x in enumerate(rows) if x[7]], budget)
    return {(rows[i][1], rows[i][2]) for i in chosen}


def test_across_documents_equals_the_choice_over_all(spark):
    rng = random.Random(1)
    rows = []
    for k in range(30):
        rows += candidates(rng, f"op{k}", rng.randint(1, 80), [0, 5, 30, 31, 100, 250, 400, 900])
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    for budget in (40, 500, 2000):
        got = r.across_documents(df, "operation", budget)
        found = {}
        for x in got.collect():
            found.setdefault(x["operation"], set()).add((x["doc_idx"], x["pos"]))
            assert x["chunk"] is not None
        for k in range(30):
            assert found.get(f"op{k}", set()) == brute([x for x in rows if x[0] == f"op{k}"], budget), (k, budget)


def test_by_score_equals_the_choice_over_all(spark):
    rng = random.Random(2)
    rows = [(f"d{i % 7}", i, rng.randint(0, 5), "y" * rng.choice([0, 1, 10, 50, 51, 300])) for i in range(400)]
    got = {(x["k"], x["pos"]) for x in r.by_score(spark.createDataFrame(rows, "k string, pos int, score int, chunk string"), "k", 400).collect()}
    want = set()
    for k in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[2], x[1]))
        want |= {(k, own[i][1]) for i in r._greedy([len(x[3]) for x in own], 400)}
    assert got == want


def test_a_hot_operation_is_a_small_group_without_text(spark):
    """Of 40,000 candidates of one operation those that can be reached are few."""
    rows = spark.range(40_000).select(
        F.lit("hot").alias("operation"), (F.col("id") % 9).cast("int").alias("doc_idx"), F.col("id").cast("int").alias("pos"), F.array(F.lit("works")).alias("tags"),
        F.create_map(F.lit("works"), (F.col("id") % 5).cast("int")).alias("hits"), F.array().cast("array<string>").alias("doc_hints"), (F.col("id") % 2 == 0).alias("numbered"), F.lit(False).alias("pinned"), (100 + F.col("id") % 40).cast("int").alias("size"), F.lit(24_000).alias("budget"),
    )
    queue, order = r._queues(rows)
    assert r.reachable(queue, ["operation", "tag"], order, ["doc_idx", "pos"], gap=2).count() <= sum(24_000 // (102 + s) for s in range(40))
    text = rows.withColumn("chunk", F.repeat(F.lit("x"), F.col("size")))
    plan = r.across_documents(text, "operation")._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("FlatMapGroupsInPandas") :].splitlines()[0]
    assert "chunk" not in grouped and r.across_documents(text, "operation").agg(F.sum(F.length("chunk") + 2)).first()[0] <= 24_000


def test_one_queue_needs_no_python(spark):
    chunks = spark.createDataFrame([("a", 0, 1, "x" * 9), ("a", 1, 3, "y" * 8), ("a", 2, 3, "z" * 4), ("a", 3, 2, "w" * 2), ("b", 0, 1, "v" * 11)], "k string, pos int, score int, chunk string")
    found = r.by_score(chunks, "k", 10)
    assert sorted(x["pos"] for x in found.collect()) == [1, 3] and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_batches_are_bounded_by_bytes(spark, sf_dir):
    """Rows of whole texts go to Python a few megabytes at a time."""
    import pyarrow as pa

    from quillstone import catalog

    catalog.table(spark, sf_dir, "documents")
    most = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x), pa.int64()), "long")
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), F.lit(10_000)).alias("x"))
    assert texts.select(most("x").alias("n")).agg(F.max("n")).first()[0] < 5 << 20
