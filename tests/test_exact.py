"""Quotes found by an index, order statistics by ranges, rounding, and white space,
against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as t, values as v
from quillstone.operators import extraction, pages, resolve
from quillstone.plans import stats
from quillstone.plans.quantiles import order_statistics


def words(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_every_substring_of_25_shares_a_fingerprint(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(60)] + ["", "a" * 24, "a" * 25, "ab" * 40]
    cuts = [(i, x[b : b + n]) for i, x in enumerate(texts) for b, n in ((rng.randint(0, max(len(x) - 25, 0)), rng.randint(25, 120)) for _ in range(5)) if len(x[b : b + n]) >= 25]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").repartition(3)
    of = {r["i"]: set(r["g"]) for r in df.select("i", resolve.grams_of(F.col("x")).alias("g")).collect()}
    got = spark.createDataFrame(cuts, "i long, x string").select("i", resolve.grams_of(F.col("x")).alias("g")).collect()
    assert got and all(r["g"] and set(r["g"]) <= of[r["i"]] for r in got)
    assert all(len(of[i]) <= max(len(x) - 24, 0) for i, x in enumerate(texts))


def brute(calls, blocks):
    hits = {}
    for op, call, q in calls:
        q = " ".join("".join(c if c.isalnum() else " " for c in q.lower()).split())
        if len(q) >= 25:
            hits[op, call] = {d for o, d, w in blocks if o == op and q[:120] in w}
    return {k: next(iter(d)) if len(d) == 1 else "" for k, d in hits.items()}


def test_quotes_of_one_large_operation(spark):
    """20,000 blocks and as many quotes of one operation, some cut within words."""
    rng = random.Random(2)
    blocks = [("A", f"d{i % 40}", words(rng, 12)) for i in range(20_000)]
    calls = []
    for i in range(20_000):
        text = blocks[rng.randrange(len(blocks))][2]
        begin = rng.randint(0, 5)
        calls.append(("A", i, text[begin:] if i % 3 else words(rng, 8)))
    b = spark.createDataFrame(blocks, "operation string, doc string, words string").withColumn("para", F.lit("x"))
    c = spark.createDataFrame(calls, "operation string, call_id int, quote string").withColumns({"citation_para": F.lit(""), "status": F.lit("found")}).repartition(4)
    got = {r["call_id"]: r["source_document"] for r in resolve.resolve(c, b).select("call_id", "source_document").collect()}
    assert len(got) == 20_000
    some = rng.sample(calls, 60)
    want = brute(some, blocks)
    assert all(got[i] == want.get((op, i), "") for op, i, _ in some)
    assert sum(1 for x in got.values() if x) > 12_000


def test_no_join_on_the_operation_alone(spark):
    b = spark.createDataFrame([("A", "d", "p", "w" * 30)], "operation string, doc string, para string, words string")
    c = spark.createDataFrame([("A", 1, "q" * 30, "")], "operation string, call_id int, quote string, citation_para string")
    plan = resolve.quote_hits(c, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (operation" not in plan.replace("((operation", "")


def test_blocks_with_white_space_of_any_kind(spark):
    text = "[a ¶1.1, p.1] one\n\n\n[b ¶2, p.2] two\n\n\t[c ¶3, p.3] three \n\n\x1c [d ¶4, p.4] four\n\nno mark\n\n[e ¶, p.1] none\n\n[f¶5, p.] five"
    got = [(r["doc"], r["para"], r["words"]) for r in resolve.blocks_of(spark.createDataFrame([("A", text)], "operation string, bundle string")).collect()]
    assert [g[:2] for g in got] == [("a", "1.1"), ("b", "2"), ("c", "3"), ("d", "4"), ("f", "5")]
    assert [g[2].split()[-1] for g in got] == ["one", "two", "three", "four", "five"]


def test_labels_with_other_line_ends(spark):
    text = "Country\r\n\r\n\tPeru \r\rProject Status Closed\x0bhttps://x.org/1\r\nLoan Proposal\r\nf.pdf\r\nMay 1\r\nEnglish"
    got = pages.page_fields(spark.createDataFrame([(1, text)], "page_id long, text string")).first()
    assert got["country"] == "Peru" and got["project_status"] == "Closed" and [d["filename"] for d in got["docs"]] == ["f.pdf"]


def test_stripped_is_strip(spark):
    rng = random.Random(4)
    blanks = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　a​"
    texts = ["".join(rng.choice(blanks) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for r in df.select("x", t.stripped(F.col("x")).alias("s"), F.split("x", t.LINE_END).alias("l")).collect():
        assert r["s"] == r["x"].strip()
        assert [x for x in r["l"] if x.strip()] == [x for x in r["x"].splitlines() if x.strip()]


def test_hundredths_are_those_of_round(spark):
    rng = random.Random(5)
    xs = [0.125, 2.675, -2.675, 1.005, -0.0, 1e13, 1e300, float("inf")] + [k / 8 for k in range(-400, 400)] + [k / 1000 for k in range(-3000, 3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 13) for _ in range(5000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", v.hundredths(F.col("x")).alias("y")).collect()
    assert all(r["y"] == (round(r["x"], 2) if math.isfinite(r["x"]) else r["x"]) for r in got)
    shown = lambda x: spark.range(1).select(v.comparable(F.lit(x), "number")).first()[0]
    assert [shown(x) for x in ("0.125", "2.675%", "1,234.567", "1e-2", "1d", "Text", "none")] == ["0.12", "2.67", "1234.57", "0.01", "1d", "text", None]


def test_millions_round_as_arrays_do(spark):
    xs = [12_345_000.0, 8_125_000.0, -12_345_000.0, 1.0, 0.0, 99_999_999.99]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(v.millions(F.col("x"))).collect()]
    assert got == (np.array(xs) / 1_000_000).round(2).tolist() and got[:2] == [12.34, 8.12]


@pytest.mark.parametrize("linear", [True, False])
def test_order_statistics(spark, linear):
    """A group of half the rows, one of ties, one of a single value, nulls, one key null."""
    rng = random.Random(6)
    rows = [("hot", float(rng.randint(-500, 500))) for _ in range(4000)] + [("ties", 7.0)] * 500 + [("one", 3.0), (None, 1.0), (None, 4.0), ("none", None)]
    rows += [(f"g{i % 40}", rng.gauss(0, 1)) for i in range(3000)]
    shares = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: (r["n"], r["q"]) for r in order_statistics(df, "x", shares, ["g"], linear).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        want = np.percentile(xs, [100 * p for p in shares]) if linear else [sorted(xs)[int(p * (len(xs) - 1))] for p in shares]
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(list(want), abs=1e-12)


def test_order_statistics_see_no_whole_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    for plan in (order_statistics(df, "id", [0.5], ["g"]), stats.lower_quantiles(df, "id", [0.5]), stats.describe(df, "id")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in text.splitlines() if "- Window [" in line]
        # Values are ordered inside one range; groups are ordered by ranges.
        assert windows and all("k#" in line and ("part#" in line or "v#" not in line) for line in windows) and "percentile" not in text
    assert stats.lower_quantiles(df.limit(0), "id", [0.5]).first()[0] is None
    assert stats.describe(df.limit(0), "id").first()["p50"] is None


def test_calls_that_are_no_objects(spark):
    bundles = spark.createDataFrame([("a", "x")], "operation string, bundle string")
    given = ["just text", {"value": "1", "status": "found"}, {"field": "odd", "value": 2}, {"field": "cofinancing_present", "value": True, "status": "found"}, 7]
    got = resolve.checked_calls(extraction.extract(bundles, lambda op, b: given)).orderBy("call_id").collect()
    assert [r["reason"] for r in got] == ["not an object", "no field", "unknown field", None, "not an object"]
    assert [r["dropped"] for r in got] == ["'just text'", "status, value", "odd", None, "7"] and got[3]["value"] == "true"


def test_quotes_of_small_and_large_operations(spark, monkeypatch):
    """Small operations are compared at once, with no fingerprint in a shuffle; the same
    calls by the index give the same hits."""
    rng = random.Random(12)
    blocks, calls = [], []
    for i in range(600):
        op, text = f"o{i % 30}", words(rng, 9)
        blocks += [(op, f"d{rng.randrange(4)}", text) for _ in range(rng.randint(1, 2))]
        calls.append((op, i, text[rng.randint(0, 9) :] if i % 4 else words(rng, 9)))
    blocks.append((None, "d", calls[1][2]))
    calls.append((None, 600, calls[1][2]))
    b = spark.createDataFrame(blocks, "operation string, doc string, words string")
    c = spark.createDataFrame(calls, "operation string, call_id int, quote string")
    found = resolve.quote_hits(c, b)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "gram" not in plan
    got = sorted(map(tuple, found.collect()))
    heads = {op: {" ".join(q.split())[:120] for o, _, q in calls if o == op and len(" ".join(q.split())) >= 25} for op, _, _ in calls if op}
    assert got == sorted({(o, h, d) for o, d, w in blocks if o for h in heads[o] if h in w}) and got
    monkeypatch.setattr(resolve, "AT_ONCE", 0)
    assert sorted(map(tuple, resolve.quote_hits(c, b).select("operation", "head", "doc").collect())) == got
