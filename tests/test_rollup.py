"""Hour -> day roll-up: severity rule edge cases, constants, coverage, totals."""

import datetime as dt

import pytest

from diurna.operators import rollup
from diurna.operators.rollup import RollupSpec
from diurna.sources.tables import HOURLY_LOG_SCHEMA

SPEC = RollupSpec(mean_cols=("t1", "t2", "hum", "wind_speed"), sum_cols=("cnt",),
                  const_cols=("season", "is_holiday", "is_weekend"), count_col="cnt",
                  severity_col="weather_code", min_run_hours=4, mean_digits=1)


def _rows(day, codes_by_hour, t1=10.0, season=0.0):
    out = []
    for h, code in codes_by_hour.items():
        out.append((dt.datetime(2015, 1, day, h), 100, t1, t1, 50.0, 5.0, float(code), 0.0, 0.0, season))
    return out


def _hourly(spark, rows):
    return spark.createDataFrame(rows, HOURLY_LOG_SCHEMA)


@pytest.fixture(scope="module")
def hourly(spark):
    rows = []
    # day 5: worst code 7 lasts exactly 3 hours -> mode (1)
    rows += _rows(5, {**{h: 1 for h in range(10)}, 10: 7, 11: 7, 12: 7, **{h: 1 for h in range(13, 24)}})
    # day 6: worst code 7 lasts exactly 4 hours -> 7
    rows += _rows(6, {**{h: 1 for h in range(10)}, 10: 7, 11: 7, 12: 7, 13: 7})
    # day 7: four 7s broken by a missing hour 12 -> run of 2 -> mode 3 (5 hours)
    rows += _rows(7, {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 10: 7, 11: 7, 13: 7, 14: 7})
    # day 8: mode tie between 1 and 2 -> the worse (2)
    rows += _rows(8, {0: 1, 1: 1, 2: 2, 5: 2})
    # day 9: a single observed hour
    rows += _rows(9, {15: 4})
    return _hourly(spark, rows)


def test_severity_rule(hourly):
    d = {r["date"].day: r["weather_code"] for r in rollup.daily_rollup(hourly, SPEC).collect()}
    assert d == {5: 1.0, 6: 7.0, 7: 3.0, 8: 2.0, 9: 4.0}


def test_longest_run(hourly):
    d = {r["date"].day: (r["worst_code"], r["longest_run"]) for r in rollup.longest_code_run(hourly, SPEC).collect()}
    assert d[5] == (7.0, 3) and d[6] == (7.0, 4) and d[7] == (7.0, 2) and d[9] == (4.0, 1)


def test_roles_and_counts(hourly):
    r = {x["date"].day: x for x in rollup.daily_rollup(hourly, SPEC).collect()}
    assert r[6]["cnt"] == 1400 and r[6]["n_hours_observed"] == 14
    assert r[9]["n_hours_observed"] == 1 and r[9]["t1"] == 10.0 and r[9]["season"] == 0.0


def test_half_even_mean(spark):
    rows = _rows(5, {0: 1}, t1=0.2) + _rows(5, {1: 1}, t1=0.3)   # mean 0.25 -> 0.2
    rows += _rows(6, {0: 1}, t1=0.3) + _rows(6, {1: 1}, t1=0.4)  # mean 0.35 -> 0.4
    d = {r["date"].day: r["t1"] for r in rollup.daily_rollup(_hourly(spark, rows), SPEC).collect()}
    assert d == {5: 0.2, 6: 0.4}


def test_day_constant_violation_reported(spark):
    rows = _rows(5, {0: 1, 1: 1}) + _rows(5, {2: 1}, season=1.0) + _rows(6, {0: 1})
    bad = rollup.day_constant_violations(_hourly(spark, rows), SPEC).collect()
    assert [(b["date"].day, b["column"]) for b in bad] == [(5, "season")] and bad[0]["lowest"] < bad[0]["highest"]
    with pytest.raises(ValueError):
        rollup.day_constant_violations(_hourly(spark, rows), SPEC, strict=True)


def test_coverage_expands_calendar(spark):
    rows = _rows(5, {h: 1 for h in range(24)}) + _rows(7, {3: 1})  # day 6 absent
    cov = {r["date"].day: (r["n_hours_observed"], r["hours_missing"])
           for r in rollup.coverage(_hourly(spark, rows), SPEC).collect()}
    assert cov == {5: (24, 0), 6: (0, 24), 7: (1, 23)}
    s = rollup.coverage_summary(rollup.coverage(_hourly(spark, rows), SPEC)).first()
    assert (s["n_days"], s["n_partial_days"], s["n_empty_days"], s["hours_missing"]) == (3, 1, 1, 47)


def test_reconcile_and_rule_discovery(hourly):
    daily = rollup.daily_rollup(hourly, SPEC)
    rec = rollup.reconcile_totals(hourly, daily, ["cnt"]).first()
    assert rec["match_cnt"] and rec["hourly_cnt"] == rec["daily_cnt"]
    found = rollup.discover_rules(hourly, daily, SPEC, ["cnt", "t1"])
    hits = {(r["column"], r["rule"]): r["days_matched"] for r in found.collect()}
    assert hits[("cnt", "sum")] == 5 and hits[("t1", "mean")] == 5


def test_events_daily_matches_flagship(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["series", "instant", "date"]


def test_low_coverage_days_among_errors_and_anomalies(spark):
    from diurna.plans.q_ml import low_coverage_overlap
    from diurna.plans.registry import REGISTRY
    days = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    cov = spark.createDataFrame([("a", 0), ("b", 3), ("c", 24), ("d", 1)], "k string, hours_missing int")
    got = low_coverage_overlap(days("a", "b"), days("b", "c"), cov, "k").collect()
    assert {(r.k, r.is_worst_error, r.is_anomaly, r.is_low_coverage, r.hours_missing) for r in got} == {
        ("a", True, False, False, 0), ("b", True, True, True, 3), ("c", False, True, True, 24)}
    assert "N7" in REGISTRY["low_coverage_overlap"].covers
    assert not any("N7" in REGISTRY[q].covers for q in ("worst_errors_flagged", "error_overlap_set"))
    out = REGISTRY["low_coverage_overlap"].build(spark, "/root/testdata/sf0.01").collect()
    assert any(r.is_low_coverage for r in out) and any(not r.is_low_coverage for r in out)
