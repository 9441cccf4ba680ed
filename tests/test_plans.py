"""Spells, track records, portfolios and splices against plain models."""

import random
from datetime import date

from pyspark.sql import functions as F

from quillstone.plans import calendars, enrich, portfolio, spells, splice, stats, track

OPS = "operation string, eligibility date, approval date, amount double, terminal_state string, completed date, last_updated date"
FLOWS = "operation string, month date, amount double, counts boolean"
RULES = spells.SpellRules(flows_cutoff="2000-12-01", data_cutoff="2001-06-01")


def d(text):
    return date(int(text[:4]), int(text[5:7]), 1) if text else None


def run(spark, ops, flows):
    o = spark.createDataFrame([(a, d(b), d(c), e, f, d(g), d(h)) for a, b, c, e, f, g, h in ops], OPS)
    f = spark.createDataFrame([(a, d(m), x, k) for a, m, x, k in flows], FLOWS)
    months = {}
    for r in spells.spell_months(o, f, RULES).orderBy("operation", "spell_month").collect():
        months.setdefault(r["operation"], []).append(r)
    summary = {r["operation"]: r for r in spells.spell_summary(o, f, RULES).collect()}
    return months, summary


def test_spell_decisions(spark):
    ops = [
        ("none", None, None, 10.0, "still_active", None, None),
        ("crosses", "2000-02", "2000-01", 100.0, "still_active", None, None),
        ("edge", None, "2000-01", 100.0, "still_active", None, None),
        ("late_start", None, "2001-03", 100.0, "still_active", None, None),
        ("gap24", None, "2000-01", 100.0, "disbursed_complete", "2000-03", None),
        ("gap25", None, "2000-01", 100.0, "disbursed_complete", "2000-03", None),
        ("ahead25", None, "1998-01", 100.0, "still_active", None, None),
        ("cancel11", None, "2000-01", None, "cancelled", None, "2000-12"),
        ("cancel12", None, "2000-01", None, "cancelled", None, "2001-01"),
        ("backwards", None, "2000-05", None, "disbursed_complete", "2000-04", None),
        ("no_amount", None, "2000-01", None, "disbursed_complete", "2000-02", None),
        ("unknown", None, "2001-05", 5.0, None, None, None),
    ]
    flows = [
        ("crosses", "2000-01", 500.0, True), ("crosses", "2000-03", 60.0, True), ("crosses", "2000-05", 38.0, True), ("crosses", "2000-06", 9.0, True),
        ("edge", "2000-12", 98.0, True), ("late_start", "2001-01", 5.0, True), ("gap24", "1998-01", 1.0, True), ("gap25", "1997-12", 1.0, False), ("gap25", "2000-02", 99.0, True),
        ("ahead25", "2000-02", 99.0, True), ("no_amount", "2000-01", 3.0, True),
    ]
    months, s = run(spark, ops, flows)
    assert s["none"]["status"] == "skipped_no_start_date" and s["none"]["n_months"] is None
    # Flows before the start are ignored; the month that reaches 0.98 is the last.
    assert [(r["month"], r["y_it"]) for r in months["crosses"]] == [(2, 0), (3, 0), (4, 0), (5, 1)]
    assert s["crosses"]["exit_reason"] == "disbursed_complete" and s["crosses"]["n_months"] == 4
    assert months["edge"][-1]["cum_share"] == 0.98 and months["edge"][-1]["y_it"] == 1 and s["edge"]["n_months"] == 12
    assert s["late_start"]["status"] == "ok" and s["late_start"]["n_months"] == 0 and "late_start" not in months
    assert s["gap24"]["outcome_resolution"] == "transaction_level" and not s["gap24"]["join_mismatch_suspected"]
    assert s["gap24"]["exit_reason"] == "disbursed_complete_post_transactions_cutoff"
    assert s["gap25"]["outcome_resolution"] == "snapshot_only" and s["gap25"]["join_mismatch_suspected"]
    assert [r["y_it"] for r in months["gap25"]] == [0, 0, 1] and months["gap25"][0]["cum_share"] is None
    assert s["ahead25"]["join_mismatch_suspected"] and s["ahead25"]["exit_reason"] == "right_censored"
    assert s["cancel11"]["exit_reason"] == "cancelled_no_date" and s["cancel11"]["n_months"] == 18
    assert s["cancel12"]["exit_reason"] == "cancelled" and s["cancel12"]["n_months"] == 13
    assert s["backwards"]["status"] == "skipped_end_before_start" and s["backwards"]["exit_reason"] is None
    assert s["no_amount"]["outcome_resolution"] == "transaction_level" and months["no_amount"][0]["monthly_disbursed"] is None
    assert s["unknown"]["exit_reason"] == "unresolved_at_cutoff"
    for op, rows in months.items():
        assert [r["spell_month"] for r in rows] == list(range(len(rows))) and len(rows) == s[op]["n_months"]
        assert sum(r["y_it"] for r in rows) <= 1


def test_no_month_row_is_sorted(spark):
    """Totals come from the operation's own flows: against a plain running sum, flows
    taken back among them, and without a window or a sort of month rows."""
    rng = random.Random(8)
    ops = [(f"o{i}", None, f"2000-{rng.randint(1, 12):02d}", 100.0, rng.choice(["still_active", "cancelled", "disbursed_complete"]), None, None) for i in range(60)]
    flows = [(f"o{rng.randrange(60)}", f"{rng.randint(1999, 2001)}-{rng.randint(1, 12):02d}", float(rng.randint(-20, 60)), rng.random() < 0.9) for _ in range(400)]
    months, s = run(spark, ops, flows)
    for op, _, start, *_ in ops:
        own, total, want = [(m, x) for o, m, x, k in flows if o == op and k], 0.0, []
        if not own:
            continue
        for k in range(int(start[5:]) - 1, 12):
            here = sum(x for m, x in own if m == f"2000-{k + 1:02d}")
            total += here
            want.append((k + 1, here, total, int(total >= 98)))
            if total >= 98:
                break
        if s[op]["outcome_resolution"] == "transaction_level":
            assert [(r["month"], r["monthly_disbursed"], r["cum_disbursed"], r["y_it"]) for r in months[op]] == want
            assert s[op]["n_months"] == len(want) and (s[op]["exit_reason"] == "disbursed_complete") == bool(want[-1][3])
    o = spark.createDataFrame([(a, d(b), d(c), e, f, d(g), d(h)) for a, b, c, e, f, g, h in ops], OPS)
    f = spark.createDataFrame([(a, d(m), x, k) for a, m, x, k in flows], FLOWS)
    for table in (spells.spell_months(o, f, RULES), spells.spell_summary(o, f, RULES)):
        assert "Window" not in table._jdf.queryExecution().executedPlan().toString()
    panel = spells.with_covariates(spells.spell_months(o, f, RULES, ["terminal_state"]), spark.createDataFrame([(2000, 1, 1)], "year int, month int, shock int"))
    assert panel._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2 and "terminal_state" in panel.columns


def test_track_record(spark):
    rows = [("a", date(2000, 1, 5), "X", 10, date(2000, 11, 1)), ("b", date(2000, 1, 5), "X", None, None), ("c", date(2000, 6, 1), "X", 20, date(2002, 2, 1)), ("d", date(2001, 1, 1), "X", 30, None), ("e", date(2001, 1, 1), None, 5, None)]
    t = spark.createDataFrame(rows, "operation string, approval date, country string, n_months long, completed date")
    got = {r[0]: tuple(r[1:]) for r in track.track_record(t, "country", "c").collect()}
    assert got == {"a": (0, None, 0), "b": (0, None, 0), "c": (2, 10.0, 1), "d": (3, 15.0, 2), "e": (None, None, None)}
    strict = {r[0]: tuple(r[1:]) for r in track.track_record(t, "country", "c", strict=True).collect()}
    assert strict["d"] == (3, 10.0, 1) and strict["c"] == (2, None, 0)


def test_weighted_shares(spark):
    schema = "operation int, country string, approval date, spell_start date, n_months long, weight double, import_share int, cofinancing_share double, fx_foreign_share int, commodity_sector_share int"
    rows = [
        (1, "A", date(2000, 3, 1), date(2000, 3, 1), 10, 3.0, 1, 0.5, None, 0), (2, "A", date(2000, 5, 1), None, None, 1.0, 0, None, None, 1),
        (3, "B", date(2000, 1, 1), None, None, 0.0, 1, 0.1, 1, 1), (4, None, date(2000, 1, 1), None, None, 9.0, 1, 0.1, 1, 1), (5, "C", date(2000, 1, 1), None, None, 5.0, None, None, 1, 0), (6, "C", date(2000, 1, 1), None, None, 0.0, 1, None, None, 0),
    ]
    out = portfolio.portfolio_shares(spark.createDataFrame(rows, schema), "2001-12-01", "year")
    got = {(r["country"], r["period"]): r for r in out.collect()}
    # Operation 1 leaves in 2001-01, so it is active at the end of 2000 and not of 2001.
    assert (got["A", "2000"]["n_active"], got["A", "2000"]["import_share"], got["A", "2000"]["cofinancing_share"]) == (2, 0.75, 0.5)
    assert got["A", "2001"]["n_active"] == 1 and got["A", "2000"]["fx_foreign_share"] is None
    assert got["B", "2000"]["import_share"] is None  # no weight at all
    assert got["C", "2000"]["import_share"] == 1.0  # stated values without weight: plain mean
    assert not any(c is None for c, _ in got)


def test_splice(spark):
    m = lambda y, k: date(y, k, 1)
    stream = spark.createDataFrame([("a", m(2000, 1), 10.0), ("a", m(2000, 3), 20.0), ("a", m(2000, 9), 99.0)], "operation string, month date, cumulative double")
    approved = spark.createDataFrame([("a", 100.0, m(1999, 1), None, None), ("b", 50.0, None, None, None), ("z", 0.0, None, None, None)], "operation string, approved double, t25 date, t50 date, t75 date")
    registry = spark.createDataFrame([("a", m(2000, 4), 40.0), ("a", m(2000, 6), -30.0), ("a", m(2000, 2), 7.0), ("b", m(2000, 6), 50.0)], "operation string, month date, amount double")
    got = {r["operation"]: r for r in splice.splice_thresholds(stream, approved, registry, cutoff="2000-03-01").collect()}
    a = got["a"]
    assert a["n_spliced_months"] == 2 and a["share_at_cutoff"] == 20.0 and a["share_after_splice"] == 60.0
    assert (a["t25_spliced"], a["t50_spliced"], a["t75_spliced"]) == ("1999-01", "2000-05", None)
    assert (a["recovered_25"], a["recovered_50"]) == (False, True) and not got["b"]["spliced"] and got["z"]["share_at_cutoff"] is None
    c = {r["threshold"]: r for r in splice.censoring(splice.splice_thresholds(stream, approved, registry, cutoff="2000-03-01")).collect()}
    assert (c[50]["censored_before"], c[50]["recovered"], c[50]["censored_after"]) == (3, 1, 2)


def test_emergency_calendar_totals(spark):
    t = calendars.covid_exposure(spark)
    r = t.agg(F.count("*"), F.sum("covid_pheic"), F.sum("covid_acute"), F.count_if(F.col("covid_intensity") == 0), F.count_if(F.col("covid_intensity") == 1), F.count_if(F.col("covid_intensity") == 2)).first()
    assert tuple(r) == (396, 41, 16, 355, 25, 16)


def test_fan_out_is_an_error(spark):
    left = spark.createDataFrame([("a",), ("b",)], "operation string")
    good = spark.createDataFrame([("a", 1)], "operation string, x int")
    assert enrich.fan_out_checked(left, good, "operation").filter("x = 1").count() == 1
    try:
        enrich.fan_out_checked(left, good.union(good), "operation").collect()
    except Exception as e:  # noqa: BLE001
        assert "repeats" in str(e)
    else:
        raise AssertionError("a repeated key passed")


def test_sample_is_bounded_and_repeats(spark):
    t = spark.range(1000).selectExpr("id", "id % 3 as a", "id % 2 as b")
    one, two = (sorted(tuple(r) for r in stats.stratified_sample(t, ["a", "b"], ["id"], 5).collect()) for _ in range(2))
    assert one == two and len(one) == 30


def test_lower_quantile_is_nearest_rank(spark):
    t = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3, 6)], "x int")
    assert tuple(stats.lower_quantiles(t, "x", (0.25, 0.5, 0.75)).first()) == (2, 3, 4)


def test_shocks_need_a_series():
    try:
        calendars.shock_table([])
    except ValueError:
        return
    raise AssertionError("an empty list passed")
