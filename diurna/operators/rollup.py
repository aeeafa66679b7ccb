"""Hour -> day roll-up by column role.

The roll-up rule follows the *role* of a column, not its name: continuous readings
are averaged, counts summed, day attributes must be constant and are carried, and
an ordered severity code takes the worst value when it lasts at least
``min_run_hours`` consecutive observed hours, else the most frequent value (ties to
the worse code).

Physical shape: the hourly input is shuffled once on (series keys, day). Every
window and the final aggregate below are clustered on those keys, so Catalyst
reuses that one hash partitioning (no further exchange). A day holds at most a
few dozen hourly rows, so a hot series cannot overload a task: its days spread
over many partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import weekday_name, working_flag


@dataclass(frozen=True)
class RollupSpec:
    time_col: str = "timestamp"
    keys: tuple = ()                    # series keys in addition to the day
    mean_cols: tuple = ()
    sum_cols: tuple = ()
    const_cols: tuple = ()
    count_col: str | None = None        # non-null count -> n_hours_observed
    severity_col: str | None = None
    min_run_hours: int = 4
    mean_digits: int | None = 1
    day_col: str = "date"
    hour_col: str = "hour"
    diagnostic_cols: tuple = field(default_factory=tuple)  # kept, never features


def with_day_hour(df: DataFrame, spec: RollupSpec) -> DataFrame:
    """Day and hour keys derived from the timestamp (fused into the scan stage)."""
    ts = F.col(spec.time_col)
    return df.withColumn(spec.day_col, F.to_date(ts)).withColumn(spec.hour_col, F.hour(ts))


def _group_cols(spec: RollupSpec) -> list[str]:
    return [*spec.keys, spec.day_col]


def day_constant_violations(hourly: DataFrame, spec: RollupSpec, cols=None,
                            strict: bool = False, nulls: bool = False) -> DataFrame:
    """(keys, day, column, lowest, highest) for every day where a day attribute varies.

    A day varies when its smallest and largest value differ (one partial aggregate for
    all columns); NULL is not a value, as with a count of distinct values. ``nulls=True``
    also reports days with NULL beside a value.
    """
    cols = list(cols if cols is not None else spec.const_cols)
    h = with_day_hour(hourly, spec)
    g = _group_cols(spec)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"),
                 F.max(F.col(c).isNull()).alias(f"__null_{c}")]
    per_day = h.groupBy(*g).agg(*aggs)
    stacked = per_day.select(*g, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__lo_{c}").cast("string").alias("lowest"),
                 F.col(f"__hi_{c}").cast("string").alias("highest"), F.col(f"__null_{c}").alias("has_null"))
        for c in cols])).alias("v")).select(*g, "v.*")
    varies = F.col("lowest") != F.col("highest")
    if nulls:
        varies = varies | (F.col("has_null") & F.col("lowest").isNotNull())
    out = stacked.where(varies).drop("has_null")
    if strict:
        bad = out.limit(1).collect()
        if bad:
            raise ValueError(f"day attribute not constant within a day: {bad[0].asDict()}")
    return out


def _severity_columns(h: DataFrame, spec: RollupSpec) -> DataFrame:
    """Adds per-row helper columns for W3/W4 over one partitioning by (keys, day)."""
    g = _group_cols(spec)
    code, hour = F.col(spec.severity_col), F.col(spec.hour_col)
    day_w = Window.partitionBy(*g)
    ordered = Window.partitionBy(*g).orderBy(spec.hour_col, F.col(spec.time_col))
    h = h.withColumn("__worst", F.max(code).over(day_w))
    is_worst = code == F.col("__worst")
    prev_code = F.lag(code).over(ordered)
    prev_hour = F.lag(hour).over(ordered)
    # The run continues only if the previous row of the day is also the worst code
    # and exactly one hour earlier: a missing hour breaks the run.
    continues = (prev_code == F.col("__worst")) & (hour == prev_hour + 1)
    h = h.withColumn("__start", (is_worst & ~F.coalesce(continues, F.lit(False))).cast("int"))
    h = h.withColumn("__run", F.sum("__start").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run_w = Window.partitionBy(*g, "__run")
    h = h.withColumn("__run_len", F.when(is_worst, F.count_if(is_worst).over(run_w)).otherwise(0))
    code_w = Window.partitionBy(*g, spec.severity_col)
    return h.withColumn("__code_n", F.count(F.lit(1)).over(code_w))


def severity_expr(spec: RollupSpec) -> Column:
    """W4 as an aggregate over rows prepared by :func:`_severity_columns`."""
    worst = F.max(F.col(spec.severity_col))
    longest = F.max("__run_len")
    # Mode with ties to the larger (worse) code.
    mode = F.max_by(F.col(spec.severity_col), F.struct(F.col("__code_n"), F.col(spec.severity_col)))
    return F.when(longest >= spec.min_run_hours, worst).otherwise(mode)


def longest_code_run(hourly: DataFrame, spec: RollupSpec) -> DataFrame:
    """Per (keys, day) the worst code and its longest run in consecutive hours."""
    h = _severity_columns(with_day_hour(hourly, spec), spec)
    return h.groupBy(*_group_cols(spec)).agg(
        F.max(F.col(spec.severity_col)).alias("worst_code"),
        F.max("__run_len").cast("int").alias("longest_run"))


def daily_rollup(hourly: DataFrame, spec: RollupSpec) -> DataFrame:
    """A10 + W4: one row per (keys, day) with role-based aggregates.

    Output columns: keys, day, means (half-even rounded), sums, constants,
    ``n_hours_observed`` (non-null count of ``count_col``), severity code.
    """
    h = with_day_hour(hourly, spec)
    if spec.severity_col:
        h = _severity_columns(h, spec)
    aggs = []
    for c in spec.mean_cols:
        m = F.avg(F.col(c))
        aggs.append((F.bround(m, spec.mean_digits) if spec.mean_digits is not None else m).alias(c))
    for c in spec.sum_cols:
        aggs.append(F.sum(F.col(c)).alias(c))
    for c in spec.const_cols:
        # After A11 the value is unique per day; ``min`` is order-free (``first`` is not).
        aggs.append(F.min(F.col(c)).alias(c))
    for c in spec.diagnostic_cols:
        aggs.append(F.min(F.col(c)).alias(c))
    if spec.count_col:
        aggs.append(F.count(F.col(spec.count_col)).cast("int").alias("n_hours_observed"))
    if spec.severity_col:
        aggs.append(severity_expr(spec).alias(spec.severity_col))
    return h.groupBy(*_group_cols(spec)).agg(*aggs)


def calendar_columns(daily: DataFrame, spec: RollupSpec, holiday_col: str | None = None,
                     weekend_col: str | None = None) -> DataFrame:
    """Instant (1.. in day order per series), year, month, day, weekday name, working."""
    d = F.col(spec.day_col)
    w = Window.partitionBy(*spec.keys).orderBy(spec.day_col) if spec.keys else Window.orderBy(spec.day_col)
    out = (daily.withColumn("instant", F.row_number().over(w).cast("int"))
           .withColumn("year", F.year(d)).withColumn("month", F.month(d))
           .withColumn("day", F.dayofmonth(d)).withColumn("weekday", weekday_name(d)))
    if holiday_col and weekend_col:
        out = out.withColumn("working", working_flag(holiday_col, weekend_col))
    return out


def coverage(hourly: DataFrame, spec: RollupSpec, hours_per_day: int = 24,
             calendar: DataFrame | None = None) -> DataFrame:
    """Observed and missing hours per (keys, day), including days with no row at all.

    The calendar is expanded from each series' first to last day (or taken from
    ``calendar``), so a wholly missing day reports ``hours_per_day`` missing hours.
    """
    h = with_day_hour(hourly, spec)
    g = _group_cols(spec)
    observed = h.groupBy(*g).agg(F.count_distinct(spec.hour_col).cast("int").alias("n_hours_observed"))
    if calendar is None:
        span = observed.groupBy(*spec.keys).agg(F.min(spec.day_col).alias("__lo"),
                                                F.max(spec.day_col).alias("__hi"))
        calendar = span.select(*spec.keys, F.explode(F.sequence("__lo", "__hi")).alias(spec.day_col))
    out = calendar.join(observed, on=g, how="left").select(
        *g, F.coalesce("n_hours_observed", F.lit(0)).alias("n_hours_observed"))
    return out.withColumn("hours_missing", (F.lit(hours_per_day) - F.col("n_hours_observed")).cast("int"))


def coverage_summary(cov: DataFrame, keys=(), hours_per_day: int = 24) -> DataFrame:
    """A24 summary: days, partial days, wholly missing days, total hours missing."""
    return cov.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if((F.col("n_hours_observed") > 0) & (F.col("n_hours_observed") < hours_per_day)).alias("n_partial_days"),
        F.count_if(F.col("n_hours_observed") == 0).alias("n_empty_days"),
        F.sum("hours_missing").cast("long").alias("hours_missing"))


def worst_coverage_days(cov: DataFrame, keys=(), k: int = 10) -> DataFrame:
    """The k days with the most missing hours (ties: earlier day first).

    A top-k: each task keeps its own k rows, k rows per task reach the merge."""
    from pyspark.sql import Window
    order = [F.col("hours_missing").desc(), *[F.col(c) for c in keys], F.col("date")]
    top = cov.where(F.col("hours_missing") > 0).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def reconcile_totals(hourly: DataFrame, daily: DataFrame, cols, keys=()) -> DataFrame:
    """Hourly total vs daily total per summed column (and per series)."""
    hs = hourly.groupBy(*keys).agg(*[F.sum(c).alias(f"hourly_{c}") for c in cols])
    ds = daily.groupBy(*keys).agg(*[F.sum(c).alias(f"daily_{c}") for c in cols])
    out = hs.join(ds, on=list(keys), how="full") if keys else hs.crossJoin(ds)
    for c in cols:
        out = out.withColumn(f"match_{c}", F.col(f"hourly_{c}") == F.col(f"daily_{c}"))
    return out


# Candidate roll-up rules tried per column.
RULES = ("sum", "mean", "max", "min", "mode", "constant")


def discover_rules(hourly: DataFrame, daily: DataFrame, spec: RollupSpec, cols,
                   tolerance: float = 1e-6, digits: int | None = None) -> DataFrame:
    """For each column and rule, how many days the rule reproduces the daily value.

    One wide aggregate produces six candidates per column; the mode needs one more
    count per (day, value) which reuses the same clustering.
    """
    h = with_day_hour(hourly, spec)
    g = _group_cols(spec)
    for c in cols:
        h = h.withColumn(f"__n_{c}", F.count(F.lit(1)).over(Window.partitionBy(*g, c)))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        cand = {
            "sum": F.sum(x), "mean": F.avg(x), "max": F.max(x), "min": F.min(x),
            "mode": F.max_by(x, F.struct(F.col(f"__n_{c}"), x)),
            "constant": F.when(F.min(x) == F.max(x), F.min(x)),
        }
        for r in RULES:
            v = cand[r]
            if digits is not None:
                v = F.bround(v, digits)
            aggs.append(v.alias(f"{c}__{r}"))
    cands = h.groupBy(*g).agg(*aggs)
    joined = cands.join(daily.select(*g, *[F.col(c).cast("double").alias(f"{c}__daily") for c in cols]),
                        on=g, how="inner")
    stats = []
    for c in cols:
        for r in RULES:
            hit = F.abs(F.col(f"{c}__{r}") - F.col(f"{c}__daily")) <= tolerance
            stats.append(F.count_if(F.coalesce(hit, F.lit(False))).alias(f"{c}__{r}"))
    wide = joined.agg(F.count(F.lit(1)).alias("n_days"), *stats)
    return wide.select("n_days", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"{c}__{r}").alias("days_matched"))
        for c in cols for r in RULES])).alias("v")).select("v.column", "v.rule", "v.days_matched", "n_days")
