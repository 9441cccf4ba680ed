"""Cohort retention against a loop over clicks."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.llm import cohorts as co

from ..compare import assert_twins

EPOCH = datetime(1970, 1, 1)
CUT = datetime(2024, 2, 15)
SHAPE = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def micros(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def late(click_id):
    h = zlib.crc32(str(click_id).encode()) if click_id is not None else 1
    return h % 100 if h % 3 == 0 else 0


def brute(clicks, segments):
    rows = {r for r in clicks if r[1] is not None and r[3] is not None}
    known = {s: [r for r in rows if s or (r[2] is not None and r[2] + timedelta(days=late(r[0])) < CUT)] for s in (0, 1)}
    start = {}
    for s, rs in known.items():
        for r in rs:
            if r[4] == "signup":
                start[s, r[3]] = min(start.get((s, r[3]), r[1]), r[1])
    cells = defaultdict(lambda: [set(), 0])
    day = lambda t: micros(t) // co.DAY
    for s, rs in known.items():
        for r in rs:
            begin = start.get((s, r[3]))
            if begin is not None and r[1] >= begin:
                cell = cells[s, segments.get(r[3]) or "", day(begin), (r[1] - begin) // timedelta(days=1)]
                cell[0].add(r[3])
                v = r[5]
                cell[1] += 0 if v is None or v != v or abs(v) == float("inf") else int((100 * v + 0.5) // 1)
    moved = {c for (s, c) in start if (0, c) in start and (1, c) in start and day(start[0, c]) != day(start[1, c])}
    return Counter((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), v) for k, (u, v) in cells.items())


def table(seed, n, clients):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(100 * co.DAY))
        rows.append((i, ts, ts + timedelta(seconds=rng.randrange(9000)), 0 if rng.random() < 0.4 else rng.randrange(clients), rng.choice(["signup", "view", "view", "click", None]), rng.choice([None, 1.005, -2.345, 0.125, 99.995, float("nan"), float("inf")]), "{}"))
    rows += rng.sample(rows, n // 10)
    t = datetime(2024, 2, 1, 12)
    day = timedelta(days=1)
    rows += [
        (None, t, t, 1, "signup", 1.0, None), (None, t, t, 1, "signup", 1.0, None), (None, t, t, 1, "signup", 1.0, "{}"), (9001, None, t, 1, "signup", 1.0, None), (9002, t, t, None, "signup", 1.0, None),
        (9003, t, None, 77, "signup", 5.0, None), (9004, t + day, t, 77, "view", 5.0, None), (9005, t + day - timedelta(microseconds=1), t, 77, "view", 5.0, None), (9006, t - day, t, 77, "view", 5.0, None),
    ]
    return rows


def frames(spark, rows):
    clicks = spark.createDataFrame(rows, SHAPE).repartition(5)
    segments = {i: random.Random(i).choice([None, "retail", "online", ""]) for i in range(0, 60)}
    clients = spark.createDataFrame(list(segments.items()), "client_id long, segment string")
    return clicks, clients, segments


def query(clicks, clients, **more):
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    return co.cohort_retention(clicks, clients, cutoff=micros(CUT), delay=F.when(h % 3 == 0, h % 100 * F.lit(co.DAY)), **more)


@pytest.mark.parametrize("slices", [1, 8, 4096])
def test_against_a_loop(spark, slices):
    """A client with four tenths of the clicks is cut into few or many slices."""
    rows = table(4, 1500, 40)
    clicks, clients, segments = frames(spark, rows)
    got = query(clicks, clients, slices=slices)
    assert got.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    want = brute(rows, segments)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(k[6] for k in want)  # some clients move


def test_times_do_not_depend_on_the_zone(spark):
    rows = table(5, 300, 30)
    clicks, clients, segments = frames(spark, rows)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert Counter(tuple(r) for r in query(clicks, clients).collect()) == brute(rows, segments)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_tables_and_repeated_clients(spark):
    rows = table(6, 60, 5)
    clicks, clients, segments = frames(spark, rows)
    assert query(clicks.limit(0), clients).count() == 0
    assert query(clicks.filter("kind != 'signup'"), clients).count() == 0
    assert Counter(tuple(r) for r in query(clicks, clients.limit(0)).collect()) == brute(rows, {})
    twice = clients.unionByName(clients.withColumn("segment", F.lit("zz")))
    assert Counter(tuple(r) for r in query(clicks, twice).collect()) == brute(rows, {c: "zz" if s is None else s for c, s in segments.items()})


def test_other_columns_tell_clicks_apart(spark):
    rows = table(7, 40, 5)
    clicks, clients, segments = frames(spark, rows)
    wide = clicks.withColumns({c: F.lit("x") for c in ("client", "at", "state", "slice", "n", "segment", "deal")})
    assert Counter(tuple(r) for r in query(wide, clients.withColumn("client", F.lit(1))).collect()) == brute(rows, segments)


def test_plan(spark, sf_dir):
    """The starts go back by a shuffle join; only the slices of large clients are broadcast."""
    plan = co.op12_cohort_retention(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1
    assert not re.search("SinglePartition|Python|Window", plan)


def test_twin(spark, sf_dir):
    assert_twins(spark, sf_dir, co.op12_cohort_retention, co.ORACLE)
