"""Entry 1: hourly log -> daily table, on the driver's ``events`` table.

``events`` is an event stream; the hourly log is derived from it per series
(``user_id`` modulo ``n_series`` — a grouping key, every row is kept):

* ``cnt``      events in the hour (count role)
* ``reading``  peak event value of the hour (continuous role)
* ``code``     ordered severity of the hour's latest event (code role)
* ``is_weekend``, ``is_holiday`` day attributes (constant role)

Hot users/series are harmless: the hourly step is a partial (map-side) aggregate,
after which a (series, day) group holds at most 24 rows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import RollupSpec, calendar_columns, daily_rollup

# Severity of an event type; unknown types count as 1.
EVENT_CODES = {"error": 7.0, "purchase": 7.0, "signup": 3.0}
DEFAULT_CODE = 1.0

EVENTS_SPEC = RollupSpec(
    time_col="timestamp", keys=("series",), mean_cols=("reading",), sum_cols=("cnt",),
    const_cols=("is_holiday", "is_weekend"), count_col="cnt", severity_col="code",
    min_run_hours=4, mean_digits=6)

DAILY_COLUMNS = ["series", "instant", "date", "year", "month", "day", "weekday", "is_holiday",
                 "is_weekend", "working", "code", "reading", "cnt", "n_hours_observed"]


def event_code(col="event_type"):
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in EVENT_CODES.items()))
    return F.coalesce(m[F.col(col)], F.lit(DEFAULT_CODE))


def hour_start(ts):
    """Start of the hour of a naive timestamp, independent of the session time zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def hourly_log(events: DataFrame, n_series: int = 4) -> DataFrame:
    """Events -> one row per (series, hour)."""
    e = events.select(
        F.pmod(F.col("user_id"), F.lit(n_series)).cast("int").alias("series"),
        hour_start(F.col("ts")).alias("timestamp"),
        "ts", "event_id", "value", event_code().alias("__code"))
    h = e.groupBy("series", "timestamp").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max("value").alias("reading"),
        F.max_by(F.col("__code"), F.struct("ts", "event_id")).alias("code"))
    dow = F.dayofweek(F.col("timestamp"))
    return (h.withColumn("is_weekend", dow.isin(1, 7).cast("double"))
            .withColumn("is_holiday", F.lit(0.0)))


def daily_table(hourly: DataFrame, spec: RollupSpec = EVENTS_SPEC) -> DataFrame:
    """A10 + W4 + calendar columns + fixed column order."""
    d = daily_rollup(hourly, spec)
    d = calendar_columns(d, spec, holiday_col="is_holiday", weekend_col="is_weekend")
    return d.select(*DAILY_COLUMNS)


def events_daily(events: DataFrame, n_series: int = 4) -> DataFrame:
    return daily_table(hourly_log(events, n_series))
