"""Registered roll-up queries on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, rollup
from ..sources.tables import read_table
from .daily import EVENTS_SPEC, events_daily, hourly_log
from .registry import register

# DuckDB building blocks mirroring plans.daily (oracle side).
SQL_HOURLY = """
  SELECT CAST(((user_id % 4) + 4) % 4 AS INTEGER) AS series,
         date_trunc('hour', ts) AS timestamp,
         CAST(count(*) AS BIGINT) AS cnt,
         max(value) AS reading,
         arg_max(CASE event_type WHEN 'error' THEN 7.0::DOUBLE WHEN 'purchase' THEN 7.0::DOUBLE
                   WHEN 'signup' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END, (ts, event_id)) AS code
  FROM events GROUP BY 1, 2"""

SQL_HOURLY_FLAGS = f"""
  SELECT *, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INTEGER) AS hour,
         CASE WHEN dayofweek(timestamp) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
         0.0::DOUBLE AS is_holiday
  FROM ({SQL_HOURLY})"""

SQL_SEVERITY_ROWS = f"""
  s1 AS (SELECT *, max(code) OVER (PARTITION BY series, date) AS worst FROM ({SQL_HOURLY_FLAGS})),
  s2 AS (SELECT *, CASE WHEN code = worst AND NOT coalesce(
             lag(code) OVER w = worst AND hour = lag(hour) OVER w + 1, false) THEN 1 ELSE 0 END AS st
         FROM s1 WINDOW w AS (PARTITION BY series, date ORDER BY hour, timestamp)),
  s3 AS (SELECT *, sum(st) OVER (PARTITION BY series, date ORDER BY hour, timestamp
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s2),
  s4 AS (SELECT *, CASE WHEN code = worst THEN
             count(*) FILTER (WHERE code = worst) OVER (PARTITION BY series, date, run) ELSE 0 END AS run_len,
             count(*) OVER (PARTITION BY series, date, code) AS code_n FROM s3)"""

SQL_DAILY = f"""
WITH {SQL_SEVERITY_ROWS},
  d AS (SELECT series, date, round_even(avg(reading), 6) AS reading, CAST(sum(cnt) AS BIGINT) AS cnt,
           min(is_holiday) AS is_holiday, min(is_weekend) AS is_weekend,
           CAST(count(cnt) AS INTEGER) AS n_hours_observed,
           CASE WHEN max(run_len) >= 4 THEN max(code) ELSE arg_max(code, (code_n, code)) END AS code
        FROM s4 GROUP BY series, date)
SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS instant,
       date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(day(date) AS INTEGER) AS day, dayname(date) AS weekday, is_holiday, is_weekend,
       CAST(is_holiday = 0 AND is_weekend = 0 AS INTEGER) AS working, code, reading, cnt, n_hours_observed
FROM d"""


def _events(spark, base):
    return read_table(spark, base, "events")


@register("hourly_log", covers=("P9", "A14"), sql=f"""
SELECT series, timestamp, cnt, round_even(reading, 6) AS reading, code, is_weekend, is_holiday
FROM ({SQL_HOURLY_FLAGS})""")
def q_hourly_log(spark, base):
    h = hourly_log(_events(spark, base))
    return h.select("series", "timestamp", "cnt", F.bround("reading", 6).alias("reading"), "code",
                    "is_weekend", "is_holiday")


@register("daily_rollup", covers=("A10", "A15", "W2", "W4", "P7", "P9", "P10", "P12", "S6", "U1"),
          sql=SQL_DAILY)
def q_daily_rollup(spark, base):
    return events_daily(_events(spark, base))


@register("longest_code_run", covers=("W3",), sql=f"""
WITH {SQL_SEVERITY_ROWS}
SELECT series, date, max(code) AS worst_code, CAST(max(run_len) AS INTEGER) AS longest_run
FROM s4 GROUP BY series, date""")
def q_longest_code_run(spark, base):
    return rollup.longest_code_run(hourly_log(_events(spark, base)), EVENTS_SPEC)


@register("day_constant_check", covers=("A11",), sql=f"""
WITH h AS ({SQL_HOURLY_FLAGS}),
 per AS (SELECT series, date,
           min(is_weekend) AS w0, max(is_weekend) AS w1, min(code) AS c0, max(code) AS c1
         FROM h GROUP BY series, date)
SELECT series, date, 'is_weekend' AS "column", CAST(w0 AS VARCHAR) AS lowest, CAST(w1 AS VARCHAR) AS highest
FROM per WHERE w0 <> w1
UNION ALL
SELECT series, date, 'code' AS "column", CAST(c0 AS VARCHAR), CAST(c1 AS VARCHAR) FROM per WHERE c0 <> c1""")
def q_day_constant_check(spark, base):
    # ``is_weekend`` is a true day attribute (no rows); ``code`` varies within days.
    return rollup.day_constant_violations(hourly_log(_events(spark, base)), EVENTS_SPEC,
                                          cols=["is_weekend", "code"])


SQL_COVERAGE = f"""
WITH h AS ({SQL_HOURLY_FLAGS}),
 obs AS (SELECT series, date, CAST(count(DISTINCT hour) AS INTEGER) AS n FROM h GROUP BY series, date),
 span AS (SELECT series, min(date) AS lo, max(date) AS hi FROM obs GROUP BY series),
 cal AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT cal.series, cal.date, CAST(coalesce(obs.n, 0) AS INTEGER) AS n_hours_observed,
       CAST(24 - coalesce(obs.n, 0) AS INTEGER) AS hours_missing
FROM cal LEFT JOIN obs ON cal.series = obs.series AND cal.date = obs.date"""


@register("hour_coverage", covers=("A24",), sql=SQL_COVERAGE)
def q_hour_coverage(spark, base):
    return rollup.coverage(hourly_log(_events(spark, base)), EVENTS_SPEC)


@register("hour_coverage_summary", covers=("A24",), sql=f"""
SELECT series, CAST(count(*) AS BIGINT) AS n_days,
       CAST(count(*) FILTER (WHERE n_hours_observed > 0 AND n_hours_observed < 24) AS BIGINT) AS n_partial_days,
       CAST(count(*) FILTER (WHERE n_hours_observed = 0) AS BIGINT) AS n_empty_days,
       CAST(sum(hours_missing) AS BIGINT) AS hours_missing
FROM ({SQL_COVERAGE}) GROUP BY series""")
def q_hour_coverage_summary(spark, base):
    cov = rollup.coverage(hourly_log(_events(spark, base)), EVENTS_SPEC)
    return rollup.coverage_summary(cov, keys=("series",))


@register("worst_coverage_days", covers=("A24", "K2"), sql=f"""
SELECT series, date, n_hours_observed, hours_missing,
       CAST(row_number() OVER (ORDER BY hours_missing DESC, series, date) AS INTEGER) AS rank
FROM ({SQL_COVERAGE}) WHERE hours_missing > 0
ORDER BY hours_missing DESC, series, date LIMIT 10""")
def q_worst_coverage_days(spark, base):
    cov = rollup.coverage(hourly_log(_events(spark, base)), EVENTS_SPEC)
    return rollup.worst_coverage_days(cov, keys=("series",), k=10)


@register("reconcile_totals", covers=("A25", "J1"), sql=f"""
WITH hs AS (SELECT series, CAST(sum(cnt) AS BIGINT) AS hourly_cnt FROM ({SQL_HOURLY}) GROUP BY series),
 ds AS (SELECT series, CAST(sum(cnt) AS BIGINT) AS daily_cnt FROM ({SQL_DAILY}) GROUP BY series),
 es AS (SELECT CAST(((user_id % 4) + 4) % 4 AS INTEGER) AS series, CAST(count(*) AS BIGINT) AS raw_cnt
        FROM events GROUP BY 1)
SELECT hs.series, hourly_cnt, daily_cnt, raw_cnt,
       hourly_cnt = daily_cnt AND daily_cnt = raw_cnt AS totals_match
FROM hs JOIN ds ON hs.series = ds.series JOIN es ON es.series = hs.series""")
def q_reconcile_totals(spark, base):
    ev = _events(spark, base)
    h = hourly_log(ev)
    d = events_daily(ev)
    rec = rollup.reconcile_totals(h, d, ["cnt"], keys=("series",))
    raw = ev.groupBy(F.pmod("user_id", F.lit(4)).cast("int").alias("series")).agg(
        F.count(F.lit(1)).alias("raw_cnt"))
    return rec.join(raw, "series").select(
        "series", "hourly_cnt", "daily_cnt", "raw_cnt",
        ((F.col("hourly_cnt") == F.col("daily_cnt")) & (F.col("daily_cnt") == F.col("raw_cnt"))).alias("totals_match"))


@register("rollup_rule_discovery", covers=("A26", "J1"), sql=f"""
WITH h AS (SELECT *, count(*) OVER (PARTITION BY series, date, cnt) AS n_cnt,
                     count(*) OVER (PARTITION BY series, date, code) AS n_code
           FROM ({SQL_HOURLY_FLAGS})),
 c AS (SELECT series, date,
        round_even(sum(CAST(cnt AS DOUBLE)), 6) AS cnt__sum, round_even(avg(CAST(cnt AS DOUBLE)), 6) AS cnt__mean,
        round_even(max(CAST(cnt AS DOUBLE)), 6) AS cnt__max, round_even(min(CAST(cnt AS DOUBLE)), 6) AS cnt__min,
        round_even(arg_max(CAST(cnt AS DOUBLE), (n_cnt, CAST(cnt AS DOUBLE))), 6) AS cnt__mode,
        round_even(CASE WHEN min(CAST(cnt AS DOUBLE)) = max(CAST(cnt AS DOUBLE)) THEN min(CAST(cnt AS DOUBLE)) END, 6) AS cnt__constant,
        round_even(sum(code), 6) AS code__sum, round_even(avg(code), 6) AS code__mean,
        round_even(max(code), 6) AS code__max, round_even(min(code), 6) AS code__min,
        round_even(arg_max(code, (n_code, code)), 6) AS code__mode,
        round_even(CASE WHEN min(code) = max(code) THEN min(code) END, 6) AS code__constant
       FROM h GROUP BY series, date),
 d AS (SELECT series, date, CAST(count(*) AS DOUBLE) AS cnt__daily,
              max(CASE event_type WHEN 'error' THEN 7.0::DOUBLE WHEN 'purchase' THEN 7.0::DOUBLE
                   WHEN 'signup' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) AS code__daily
       FROM (SELECT CAST(((user_id % 4) + 4) % 4 AS INTEGER) AS series, CAST(ts AS DATE) AS date, event_type
             FROM events) GROUP BY series, date),
 j AS (SELECT * FROM c JOIN d USING (series, date))
SELECT "column", rule, CAST(days_matched AS BIGINT) AS days_matched, CAST(n_days AS BIGINT) AS n_days FROM (
  SELECT count(*) AS n_days,
    count(*) FILTER (WHERE abs(cnt__sum - cnt__daily) <= 1e-6) AS cnt_sum,
    count(*) FILTER (WHERE abs(cnt__mean - cnt__daily) <= 1e-6) AS cnt_mean,
    count(*) FILTER (WHERE abs(cnt__max - cnt__daily) <= 1e-6) AS cnt_max,
    count(*) FILTER (WHERE abs(cnt__min - cnt__daily) <= 1e-6) AS cnt_min,
    count(*) FILTER (WHERE abs(cnt__mode - cnt__daily) <= 1e-6) AS cnt_mode,
    count(*) FILTER (WHERE abs(cnt__constant - cnt__daily) <= 1e-6) AS cnt_constant,
    count(*) FILTER (WHERE abs(code__sum - code__daily) <= 1e-6) AS code_sum,
    count(*) FILTER (WHERE abs(code__mean - code__daily) <= 1e-6) AS code_mean,
    count(*) FILTER (WHERE abs(code__max - code__daily) <= 1e-6) AS code_max,
    count(*) FILTER (WHERE abs(code__min - code__daily) <= 1e-6) AS code_min,
    count(*) FILTER (WHERE abs(code__mode - code__daily) <= 1e-6) AS code_mode,
    count(*) FILTER (WHERE abs(code__constant - code__daily) <= 1e-6) AS code_constant
  FROM j) t,
  LATERAL (VALUES ('cnt', 'sum', cnt_sum), ('cnt', 'mean', cnt_mean), ('cnt', 'max', cnt_max),
                  ('cnt', 'min', cnt_min), ('cnt', 'mode', cnt_mode), ('cnt', 'constant', cnt_constant),
                  ('code', 'sum', code_sum), ('code', 'mean', code_mean), ('code', 'max', code_max),
                  ('code', 'min', code_min), ('code', 'mode', code_mode), ('code', 'constant', code_constant))
   v("column", rule, days_matched)""")
def q_rollup_rule_discovery(spark, base):
    """Which hour->day rule reproduces a day table computed straight from the events."""
    ev = _events(spark, base)
    h = hourly_log(ev)
    from .daily import event_code
    daily_direct = (ev.select(F.pmod("user_id", F.lit(4)).cast("int").alias("series"),
                              F.to_date("ts").alias("date"), event_code().alias("code"))
                    .groupBy("series", "date")
                    .agg(F.count(F.lit(1)).cast("double").alias("cnt"), F.max("code").alias("code")))
    return rollup.discover_rules(h, daily_direct, EVENTS_SPEC, ["cnt", "code"], digits=6)


SQL_GRID = f"""
WITH h AS (SELECT series, timestamp, reading FROM ({SQL_HOURLY})),
 span AS (SELECT series, min(timestamp) AS lo, max(timestamp) AS hi FROM h GROUP BY series),
 grid AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM span),
 g AS (SELECT grid.series, grid.timestamp, h.reading FROM grid LEFT JOIN h
         ON grid.series = h.series AND grid.timestamp = h.timestamp)"""


@register("interpolate_hours", covers=("W1",), sql=f"""
{SQL_GRID},
 p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY timestamp) AS pos FROM g),
 q AS (SELECT *,
   last_value(CASE WHEN reading IS NOT NULL THEN pos END IGNORE NULLS) OVER
     (PARTITION BY series ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
   last_value(reading IGNORE NULLS) OVER
     (PARTITION BY series ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
   first_value(CASE WHEN reading IS NOT NULL THEN pos END IGNORE NULLS) OVER
     (PARTITION BY series ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
   first_value(reading IGNORE NULLS) OVER
     (PARTITION BY series ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM p)
SELECT series, timestamp, round_even(reading, 6) AS reading_raw,
  round_even(CASE WHEN reading IS NOT NULL THEN reading
       WHEN p0 IS NULL THEN NULL
       WHEN p1 IS NULL THEN v0
       ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) AS reading
FROM q""")
def q_interpolate_hours(spark, base):
    """Expand each series to every hour; missing hours are gaps filled by position."""
    h = hourly_log(_events(spark, base)).select("series", "timestamp", "reading")
    span = h.groupBy("series").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    grid = span.select("series", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("timestamp"))
    g = grid.join(h, ["series", "timestamp"], "left")
    # bucketed by day: no window holds a whole series, however long it is
    out = clean.interpolate_linear(g, "reading", order_by="timestamp", keys=("series",),
                                   out_col="reading_filled", bucket=F.to_date("timestamp"))
    return out.select("series", "timestamp", F.bround("reading", 6).alias("reading_raw"),
                      F.bround("reading_filled", 6).alias("reading"))
