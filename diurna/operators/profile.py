"""Profiles and exploratory tables.

Each function is one or two aggregate passes: statistics for many columns are
computed in a single ``agg`` (partial aggregation on every executor, one small
final merge) and unpivoted afterwards, instead of one job per column.

Quantiles are exact (linear interpolation, pandas' default) with bounded memory for any
number of rows, ties and groups (:func:`wide_quantiles`); ``accuracy=`` asks for
``percentile_approx`` instead.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import qcol
from ..session import cut_lineage
from .ranking import global_row_number

QUARTILES = (0.25, 0.5, 0.75)


def _q(c: str, p: float, accuracy: int | None = None) -> Column:
    if accuracy:
        return F.percentile_approx(F.col(c), F.lit(p), accuracy)
    return F.percentile(F.col(c), F.lit(p))


def _unpivot(wide: DataFrame, cols, stats, key_name="column") -> DataFrame:
    """Wide one-row stats ``{col}__{stat}`` -> one row per column."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(key_name), *[F.col(f"{c}__{s}").alias(s) for s in stats])
        for c in cols])).alias("v")).select("v.*")


def shape(df: DataFrame) -> DataFrame:
    """A1: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """A2: column name and type, in schema order (metadata only, no scan)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def missing_counts(df: DataFrame, cols=None, total: bool = True) -> DataFrame:
    """A3: NULL (and NaN) count per column in one pass, optional total row."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def missing(c):
        cond = F.col(c).isNull()
        if c in numeric:
            cond = cond | F.isnan(F.col(c))
        return F.count_if(cond)

    wide = df.agg(*[missing(c).alias(f"{c}__missing_count") for c in cols])
    out = _unpivot(wide, cols, ["missing_count"])
    if total:
        out = out.unionByName(out.agg(F.lit("__total__").alias("column"),
                                      F.sum("missing_count").cast("long").alias("missing_count")))
    return out


def describe(df: DataFrame, cols, accuracy: int | None = None, digits: int | None = None) -> DataFrame:
    """Count, mean, std (ddof 1), min, 25/50/75 %, max per column.

    Moments in one aggregate for all columns; quartiles exact with bounded memory
    (``accuracy=`` switches to a sketch)."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                 F.max(F.col(c).cast("double")).alias(f"{c}__max")]
    mom = _unpivot(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    out = mom.join(_quartile_table(df, cols, QUARTILES, accuracy), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    if digits is not None:
        out = out.select("column", "count", *[F.bround(s, digits).alias(s)
                                              for s in ("mean", "std", "min", "q25", "q50", "q75", "max")])
    return out


def quantiles(df: DataFrame, col: str, probs, keys=(), accuracy: int | None = None) -> DataFrame:
    """A5: quantiles of one column, optionally per group, as rows (p, value)."""
    if not accuracy:
        return exact_quantiles(df, col, probs, keys=keys)
    g = df.groupBy(*keys) if keys else df.groupBy()
    wide = g.agg(*[_q(col, p, accuracy).alias(f"q{i}") for i, p in enumerate(probs)])
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("value"))
        for i, p in enumerate(probs)])).alias("v")).select(*keys, "v.p", "v.value")


def iqr_outliers(df: DataFrame, cols, k: float = 1.5, accuracy: int | None = None,
                 digits: int | None = 4) -> DataFrame:
    """Per column Q1, Q3, bounds at ±k·IQR and the number of rows outside.

    Pass 1 computes all quartiles in one aggregate; pass 2 counts outside rows for
    all columns at once against that one-row result (a broadcast of fixed size).
    """
    qt = _quartile_table(df, cols, (0.25, 0.75), accuracy)
    b = qt.agg(*[F.max(F.when(F.col("column") == c, F.col(q))).alias(f"{c}__{n}")
                 for c in cols for q, n in (("q25", "q1"), ("q75", "q3"))])
    for c in cols:
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        b = (b.withColumn(f"{c}__lo", F.col(f"{c}__q1") - k * iqr)
             .withColumn(f"{c}__hi", F.col(f"{c}__q3") + k * iqr))
    joined = df.select(*cols).crossJoin(F.broadcast(b))
    counts = joined.agg(*[F.count_if((F.col(c) < F.col(f"{c}__lo")) | (F.col(c) > F.col(f"{c}__hi")))
                          .alias(f"{c}__outlier_count") for c in cols],
                        *[F.first(F.col(f"{c}__{s}")).alias(f"{c}__{s}") for c in cols
                          for s in ("q1", "q3", "lo", "hi")])
    out = _unpivot(counts, cols, ["q1", "q3", "lo", "hi", "outlier_count"])
    out = out.select("column", F.col("q1").alias("Q1"), F.col("q3").alias("Q3"),
                     F.col("lo").alias("lower_bound"), F.col("hi").alias("upper_bound"), "outlier_count")
    if digits is not None:
        out = out.select("column", *[F.bround(c, digits).alias(c) for c in
                                     ("Q1", "Q3", "lower_bound", "upper_bound")], "outlier_count")
    return out


def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (a top-k: one small sort per partition)."""
    return df.orderBy(*order_by).limit(n)


def group_means(df: DataFrame, keys, measures) -> DataFrame:
    """Group mean of one or more measures."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures])


def reindex(agg: DataFrame, domain: DataFrame, keys) -> DataFrame:
    """Complete a grouped result to a fixed key domain (absent keys give NULLs).

    ``domain`` is the small dimension (codes, nations, weekdays); Catalyst
    broadcasts it when its size is under the broadcast threshold.
    """
    return domain.join(agg, on=list(keys), how="left")


def value_counts(df: DataFrame, col: str, by: str = "count") -> DataFrame:
    """Counts per value with an explicit rank (by count desc or by key)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col("count").desc(), F.col(col)] if by == "count" else [F.col(col)]
    return global_row_number(c, order, "rank", start=1).withColumn("rank", F.col("rank").cast("int"))


def split_profile(df: DataFrame, col: str, split_col: str = "split",
                  left: str = "train", right: str = "test") -> DataFrame:
    """Per value, counts in two parts side by side; absent on one side -> NULL.

    One aggregate instead of two counts and a full outer join.
    """
    nl = F.count_if(F.col(split_col) == left)
    nr = F.count_if(F.col(split_col) == right)
    return df.groupBy(col).agg(F.when(nl > 0, nl).alias(left), F.when(nr > 0, nr).alias(right))


def pivot_mean(df: DataFrame, row: str, col: str, values, measure: str) -> DataFrame:
    """Mean pivot with the column domain fixed (no extra job to discover it).

    Values absent from the data still get a (NULL) column; the caller can drop
    all-NULL ones to reproduce 'missing columns tolerated'.
    """
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(measure))


def pivot_extremes(pivoted: DataFrame, row: str) -> DataFrame:
    """Min, max and mid-point over all cells of a pivot."""
    cells = [c for c in pivoted.columns if c != row]
    long = pivoted.select(F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in cells])).alias("v"))
    return long.agg(F.min("v").alias("cell_min"), F.max("v").alias("cell_max"),
                    ((F.min("v") + F.max("v")) / 2).alias("cell_mid"))


def correlation_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r and the least-squares line y = slope·x + intercept."""
    return df.agg(F.corr(x, y).alias("pearson_r"), F.regr_slope(y, x).alias("slope"),
                  F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("x_min"),
                  F.max(x).alias("x_max"), F.count(F.lit(1)).alias("n"))


def trend_points(trend: DataFrame, n_points: int = 100) -> DataFrame:
    """``n_points`` evenly spaced evaluations of the trend line over [x_min, x_max]."""
    i = F.col("i")
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * i / F.lit(n_points - 1)
    return (trend.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
            .select(i.alias("point"), x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y")))


def _group_quartiles(df: DataFrame, group: str, measure: str, accuracy):
    n = df.groupBy(group).agg(F.count(measure).alias("n"))
    if accuracy:
        q = df.groupBy(group).agg(_q(measure, .25, accuracy).alias("q1"), _q(measure, .5, accuracy).alias("median"),
                                  _q(measure, .75, accuracy).alias("q3"))
    else:
        e = exact_quantiles(df, measure, QUARTILES, keys=[group])
        q = e.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(a)
                                   for p, a in zip(QUARTILES, ("q1", "median", "q3"))])
    return cut_lineage(q.join(n, group))                     # read twice: at the rows and in the result


def box_stats(df: DataFrame, group: str, measure: str, whis: float = 1.5,
              accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers at the last data point within whis·IQR, flier count.

    Pass 1: quartiles per group. Pass 2: join them back (one row per group, those of large
    groups broadcast) and take conditional min/max/counts.
    """
    q = _group_quartiles(df, group, measure, accuracy)
    q = (q.withColumn("lo_fence", F.col("q1") - whis * (F.col("q3") - F.col("q1")))
          .withColumn("hi_fence", F.col("q3") + whis * (F.col("q3") - F.col("q1"))))
    v = F.col(measure)
    j = with_groups(df.select(group, measure), q, [group], "n")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    w = j.groupBy(group).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))
    return q.join(w, on=group).select(group, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers")


def box_fliers(df: DataFrame, group: str, measure: str, whis: float = 1.5) -> DataFrame:
    """The flier rows themselves (outside the whiskers' fences)."""
    q = _group_quartiles(df, group, measure, None).select(group, "q1", "q3", F.col("n").alias("__n"))
    j = with_groups(df, q, [group], "__n").drop("__n")
    iqr = F.col("q3") - F.col("q1")
    v = F.col(measure)
    return j.where((v < F.col("q1") - whis * iqr) | (v > F.col("q3") + whis * iqr)).drop("q1", "q3")


def gaussian_kde(df: DataFrame, measure: str, group: str, grid_size: int = 200, cut: float = 3.0,
                 bin_width: float | None = None) -> DataFrame:
    """Gaussian kernel density per group on a regular grid (Scott's factor).

    The sample is first reduced to (value, count) pairs, so the density costs
    O(distinct values x grid) instead of O(rows x grid). It is exact at every size;
    ``bin_width`` asks for values snapped to bins, for long continuous samples. The grid
    spans each group's [min - cut·bw, max + cut·bw].
    """
    v = F.col(measure).cast("double")
    if bin_width:
        v = (F.floor(v / bin_width) + 0.5) * bin_width
    binned = df.select(F.col(group), v.alias("x")).groupBy(group, "x").agg(F.count(F.lit(1)).alias("w"))
    stats = df.groupBy(group).agg(F.count(measure).alias("n"), F.stddev_samp(measure).alias("sd"),
                                  F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    stats = stats.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = stats.select(group, "n", "bw", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("point"),
                        "lo", "hi").withColumn(
        "grid_x", F.col("lo") - cut * F.col("bw")
        + (F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) * F.col("point") / F.lit(grid_size - 1))
    j = grid.join(binned, on=group)
    z = (F.col("grid_x") - F.col("x")) / F.col("bw")
    dens = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / (F.first("n") * F.first("bw") * math.sqrt(2 * math.pi))
    return j.groupBy(group, "point", "grid_x").agg(dens.alias("density"))


def welch_contrast(df: DataFrame, measure: str, group: str, a, b, by: str | None = None) -> DataFrame:
    """Two-sample contrast: means, percent change b vs a, Welch t and df.

    One aggregate (n, mean, var per side) per ``by`` level plus a total row.
    """
    def side(v):
        sel = F.col(group) == F.lit(v)
        x = F.when(sel, F.col(measure).cast("double"))
        return F.count(x), F.avg(x), F.var_samp(x)

    na, ma, va = side(a)
    nb, mb, vb = side(b)
    aggs = [na.alias("n_a"), ma.alias("mean_a"), va.alias("var_a"),
            nb.alias("n_b"), mb.alias("mean_b"), vb.alias("var_b")]
    total = df.agg(*aggs).withColumn(by or "subset", F.lit("__total__")) if by else \
        df.agg(*aggs).withColumn("subset", F.lit("__total__"))
    key = by or "subset"
    parts = df.groupBy(F.col(by).cast("string").alias(by)).agg(*aggs).unionByName(total) if by else total
    sa = F.col("var_a") / F.col("n_a")
    sb = F.col("var_b") / F.col("n_b")
    return parts.select(
        key, "n_a", "mean_a", "n_b", "mean_b",
        ((F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100).alias("pct_change"),
        ((F.col("mean_b") - F.col("mean_a")) / F.sqrt(sa + sb)).alias("welch_t"),
        (F.pow(sa + sb, 2) / (F.pow(sa, 2) / (F.col("n_a") - 1) + F.pow(sb, 2) / (F.col("n_b") - 1))).alias("welch_df"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with their sort position."""
    return global_row_number(df.select(col).distinct(), [F.col(col)], "position", start=1).withColumn(
        "position", F.col("position").cast("int"))


def order_statistic(df: DataFrame, col: str, k: int) -> float:
    """The k-th smallest value (0-based), exact, bounded memory."""
    return float(exact_quantiles(df, col, [], ranks=[k]).first()["value"])


def exact_quantile(df: DataFrame, col: str, p: float) -> float | None:
    """One exact quantile of one column (see :func:`wide_quantiles`)."""
    r = exact_quantiles(df, col, [p]).first()
    return None if r is None else float(r["value"])


def _quartile_table(df: DataFrame, cols, probs, accuracy):
    """(column, q<pct>...) for several columns: exact (bounded memory) or sketch."""
    names = {p: f"q{int(round(p * 100))}" for p in probs}
    if accuracy:
        wide = df.agg(*[F.percentile_approx(F.col(c), F.lit(p), accuracy).alias(f"{c}__{names[p]}")
                        for c in cols for p in probs])
        return _unpivot(wide, cols, [names[p] for p in probs])
    q = wide_quantiles(df, cols, probs)
    return q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(names[p])
                                     for p in probs])


def exact_quantiles(df: DataFrame, col: str, probs, keys=(), ranks=None, **kw) -> DataFrame:
    """Exact quantiles of one column per group: (keys, p, value); see :func:`wide_quantiles`.

    With ``ranks`` (0-based, global only) order statistics are returned, ``p`` holding the rank."""
    if ranks is None:
        return wide_quantiles(df, [col], probs, keys, **kw).drop("column")
    if keys:
        raise ValueError("ranks are supported for a global order statistic only")
    x = qcol(col).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).count()
    bad = [k for k in ranks if not 0 <= k < n]
    if bad:
        raise ValueError(f"ranks {bad} outside [0, {n})")
    return wide_quantiles(df, [col], ranks, (), order_of=n, **kw).drop("column")


# column, probability, rank, bracket, and whether the bracket is as narrow as sketches make it
_TARGET = "array<struct<c:int,p:double,k:bigint,lo:double,hi:double,f:boolean>>"
HOT_GROUPS = 4096          # groups whose row is broadcast to the rows


def with_groups(rows: DataFrame, table: DataFrame, keys, size: str, hot: int = HOT_GROUPS) -> DataFrame:
    """Rows with their group's row of ``table``, one per ``keys``. The ``hot`` groups of the largest ``size`` are
    broadcast, so theirs stay where they are; of the others none has more than 1/hot of all, and they are shuffled."""
    if not keys:
        return rows.crossJoin(F.broadcast(table))            # one row
    own = [f"__g{i}" for i in range(len(keys))]
    t = table.select(*[qcol(k).alias(g) for k, g in zip(keys, own)], *[qcol(c) for c in table.columns if c not in keys])

    def on(left, right, pairs):
        cond = F.lit(True)
        for a, b in pairs:
            cond = cond & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
        return cond
    mine = list(zip(keys, own))
    if t.limit(hot + 1).count() <= hot:
        few = F.broadcast(t)
        return rows.join(few, on(rows, few, mine)).drop(*own)
    top = t.orderBy(F.col(size).desc(), *own).limit(hot)
    names = top.select(*[F.col(g).alias(f"{g}_") for g in own])
    theirs = [f"{g}_" for g in own]
    rest = t.join(F.broadcast(names), on(t, names, zip(own, theirs)), "left_anti")
    others = rows.join(F.broadcast(names), on(rows, names, zip(keys, theirs)), "left_anti")
    return rows.join(F.broadcast(top), on(rows, top, mine)).unionByName(others.join(rest, on(others, rest, mine))).drop(*own)


def wide_quantiles(df: DataFrame, cols, probs, keys=(), accuracy: int = 10_000, few: int = 10_000,
                   most: int = 1_000_000, order_of: int | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of several columns per group: (keys, column, p, value).

    1. One aggregate over all columns: count, least, largest, and a mergeable sketch's values a little below
       and above each probability. They bracket the wanted order statistics (a group of at most ``few``
       rows is its own bracket).
    2. One aggregate counts the rows below and inside each bracket. A bracket that the sketch
       missed, or with more than ``most`` rows, is cut by a sketch of its own rows and counted again.
    3. A bracket of one value is that value. Of the others the distinct values inside are counted (in the
       tasks first, so ties and hot groups cost a row per task) and the wanted ranks read off.

    Three scans, whatever the range of values; further ones only where n is beyond
    ``accuracy * most / 6``. No rows are sorted, large groups' rows are not shuffled (:func:`with_groups`)
    and nothing about groups is on the driver. Values must be finite; NULL and NaN are left out.
    """
    keys, cols, probs = list(keys), list(cols), list(probs)
    if not probs or not cols:
        raise ValueError("no columns or no probabilities")
    gk = [f"__k{i}" for i in range(len(keys))]
    value = lambda c: F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double"))
    d = df.select(*[qcol(k).alias(g) for k, g in zip(keys, gk)], *[value(c).alias(f"__x{i}") for i, c in enumerate(cols)])
    x = [F.col(f"__x{i}") for i in range(len(cols))]
    if order_of is not None:
        share = [(r + 0.5) / order_of for r in probs]
    else:
        share = probs
    near = [min(max(s + e, 0.0), 1.0) for s in share for e in (-3 / accuracy, 3 / accuracy)]
    first = d.groupBy(*gk).agg(F.count(F.lit(1)).alias("size"), *[e for i, c in enumerate(x) for e in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
        F.percentile_approx(c, near, accuracy).alias(f"q{i}"))])

    def target(i, j):
        """Both order statistics of column i at probability j, in the bracket around them; no rank without values."""
        n, q = F.col(f"n{i}"), F.col(f"q{i}")
        at = F.lit(float(probs[j])) * (n - 1) if order_of is None else F.lit(float(probs[j]))
        small = n <= few
        lo = F.when(small, F.col(f"lo{i}")).otherwise(F.element_at(q, 2 * j + 1))
        hi = F.when(small, F.col(f"hi{i}")).otherwise(F.element_at(q, 2 * j + 2))
        return F.array(*[F.struct(F.lit(i).alias("c"), F.lit(float(probs[j])).alias("p"), F.when(n > 0, k.cast("long")).alias("k"),
                                  lo.alias("lo"), hi.alias("hi"), F.lit(False).alias("f")) for k in (F.floor(at), F.ceil(at))])
    ends = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                     for i in range(len(cols))])
    wanted = first.select(*gk, "size", ends.alias("ends"), F.flatten(F.array(*[
        target(i, j) for i in range(len(cols)) for j in range(len(probs))])).cast(_TARGET).alias("t"))
    state = cut_lineage(wanted)
    m = 2 * len(cols) * len(probs)
    of = [x[j // (2 * len(probs))] for j in range(m)]        # the column of each target
    bounds = lambda t, only=F.lit(True): [F.when(only(j) if callable(only) else only, t[j][e]).alias(f"{e}{j}")
                                          for j in range(m) for e in ("lo", "hi")]
    within = [(v >= F.col(f"lo{j}")) & (v <= F.col(f"hi{j}")) for j, v in enumerate(of)]
    while True:
        counts = with_groups(d, state.select(*gk, "size", *bounds(F.col("t"))), gk, "size").groupBy(*gk).agg(
            *[F.count_if(v < F.col(f"lo{j}")).alias(f"b{j}") for j, v in enumerate(of)],
            *[F.count_if(v).alias(f"i{j}") for j, v in enumerate(within)])
        counts = counts.select(*[F.col(g).alias(f"{g}_") for g in gk], F.array(*[f"b{j}" for j in range(m)]).alias("below"),
                               F.array(*[f"i{j}" for j in range(m)]).alias("inside"))
        joined = state.join(counts, _same(gk)) if gk else state.crossJoin(F.broadcast(counts))
        counted = cut_lineage(joined.select(*gk, "size", "ends", F.expr(
            "transform(t, (x, i) -> struct(x.c, x.p, x.k, x.lo, x.hi, x.f, below[i] AS below, inside[i] AS inside))").alias("t")))
        missed = "x.k < x.below OR x.k >= x.below + x.inside"
        if counted.where(F.expr(f"exists(t, x -> {missed} OR (x.inside > {most} AND x.lo < x.hi AND NOT x.f))")).isEmpty():
            break
        # brackets that the sketch missed go on with the rest on their side, large ones with a sketch of their own
        moved = counted.withColumn("t", F.expr(f"""transform(t, x -> struct(x.c, x.p, x.k,
            CASE WHEN x.k < x.below THEN ends[x.c].lo WHEN {missed} THEN x.hi ELSE x.lo END AS lo,
            CASE WHEN x.k < x.below THEN x.lo WHEN {missed} THEN ends[x.c].hi ELSE x.hi END AS hi, x.f,
            CASE WHEN {missed} THEN -1L ELSE x.below END AS below, x.inside))"""))
        state = cut_lineage(_narrowed(d, x, moved, gk, accuracy, most))
    wide = lambda j: F.col("t")[j]["lo"] < F.col("t")[j]["hi"]
    some = F.lit(False)
    for v in within:
        some = some | F.coalesce(v, F.lit(False))
    inside = with_groups(d, counted.select(*gk, "size", *bounds(F.col("t"), wide), F.expr(
        "array_distinct(transform(filter(t, x -> x.lo < x.hi), x -> struct(x.c, x.lo, x.hi, x.below)))").alias("t")),
        gk, "size").where(some).select(*gk, "t", F.array(*x).alias("__x")).select(
        *gk, F.expr("explode(transform(filter(t, b -> __x[b.c] >= b.lo AND __x[b.c] <= b.hi), "
                    "b -> struct(b.c, b.lo, b.hi, b.below, __x[b.c] AS v)))").alias("b")).select(*gk, "b.*")
    bracket = [*gk, "c", "lo", "hi", "below"]
    values = inside.groupBy(*bracket, "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*bracket).orderBy("v")) + F.col("below")
    values = values.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("times"))
    one = counted.select(*gk, F.explode("t").alias("t")).select(*gk, "t.*").where("k IS NOT NULL").distinct()
    o, w = one.where("lo < hi").alias("o"), values.alias("w")
    on = (F.col("o.k") >= F.col("w.after")) & (F.col("o.k") < F.col("w.upto"))
    for c in bracket:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}"))
    found = o.join(w, on).select(*[F.col(f"o.{g}").alias(g) for g in gk], F.col("o.c").alias("c"), F.col("o.p").alias("p"),
                                 F.col("o.k").alias("k"), F.col("w.v").alias("v"))
    found = found.unionByName(one.where("lo = hi").select(*gk, "c", "p", "k", (F.col("lo") + F.lit(0.0)).alias("v")))
    ns = state.select(*gk, F.posexplode(F.col("ends")).alias("c", "e")).select(*gk, "c", F.col("e.n").alias("n"))
    g = found.groupBy(*gk, "c", "p").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("k").alias("k"))
    a, b = g.alias("a"), ns.alias("b")
    on = F.col("a.c") == F.col("b.c")
    for k in gk:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    part = F.lit(0.0) if order_of is not None else F.col("a.p") * (F.col("b.n") - 1) - F.col("a.k")
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("a.c") + 1)
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(n) for n, k in zip(keys, gk)], name.alias("column"),
                                F.col("a.p").alias("p"), (F.col("a.a") + (F.col("a.b") - F.col("a.a")) * part).alias("value"))


def _narrowed(d: DataFrame, x: list, moved: DataFrame, gk, accuracy: int, most: int) -> DataFrame:
    """Targets whose brackets still need it are cut at a grid of the values that a sketch of their rows gives."""
    grid = max(min(1000, accuracy // 10), 4)       # coarser than the sketch errs
    wide = moved.select(*gk, "size", F.expr(
        f"array_distinct(filter(t, x -> x.below < 0 OR (x.inside > {most} AND NOT x.f)))").alias("t"))
    rows = with_groups(d, wide, gk, "size").select(*gk, "t", F.array(*x).alias("__x")).select(*gk, F.expr(
        "explode(transform(filter(t, b -> __x[b.c] >= b.lo AND __x[b.c] <= b.hi), "
        "b -> struct(b.c, b.p, b.k, b.lo, b.hi, b.below, __x[b.c] AS v)))").alias("b")).select(*gk, "b.*")
    per = rows.groupBy(*gk, "c", "p", "k", "lo", "hi", "below").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [i / grid for i in range(grid + 1)], accuracy).alias("q"))
    # a missed bracket does not know how many rows are below it: it keeps its ends for the next count
    place = F.floor((F.col("k") - F.col("below")) / F.col("n") * grid).cast("int")
    cut = lambda step: F.element_at("q", F.greatest(F.lit(1), F.least(F.lit(grid + 1), place + 1 + step)))
    known = F.col("below") >= 0
    per = per.select(*gk, "c", "p", "k", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"),
                     F.when(known, cut(-2)).otherwise(F.col("lo")).alias("lo"),
                     F.when(known, cut(3)).otherwise(F.col("hi")).alias("hi"), known.alias("known"))
    same = F.col("known") & (F.col("lo") == F.col("old_lo")) & (F.col("hi") == F.col("old_hi"))
    new = per.groupBy(*gk).agg(F.collect_list(F.struct("c", "p", "k", "old_lo", "old_hi", "lo", "hi", same.alias("f"))).alias("u"))
    joined = moved.crossJoin(F.broadcast(new)) if not gk else moved.join(
        new.select(*[F.col(g).alias(g + "_") for g in gk], "u"),
        _same(gk), "left").drop(*[g + "_" for g in gk])
    return joined.select(*gk, "size", "ends", F.expr("""transform(t, x -> coalesce(
        try_element_at(transform(filter(coalesce(u, array()), y -> y.c = x.c AND y.p = x.p AND y.k = x.k AND y.old_lo = x.lo
                             AND y.old_hi = x.hi), y -> struct(y.c, y.p, y.k, y.lo, y.hi, y.f)), 1),
        struct(x.c, x.p, x.k, x.lo, x.hi, x.f)))""").cast(_TARGET).alias("t"))


def _same(gk) -> Column:
    on = F.lit(True)
    for g in gk:
        on = on & F.col(g).eqNullSafe(F.col(g + "_"))
    return on


def _betacf(a, b, x, iters: int = 300, eps: float = 1e-15):
    """Continued fraction of the regularized incomplete beta (modified Lentz)."""
    import numpy as np
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h *= delta
        if np.all(np.abs(delta - 1.0) < eps):
            break
    return h


def student_t_two_sided_p(t, df):
    """Two-sided p-value of Student's t with (fractional) degrees of freedom.

    p = I_x(df/2, 1/2) with x = df / (df + t²), the regularized incomplete beta.
    Vectorised numpy; used on small result tables (a handful of contrasts)."""
    import math
    import numpy as np
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    lbeta = np.vectorize(lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v))(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - lbeta)
    direct = front * _betacf(a, b, x) / a                     # valid for x < (a+1)/(a+b+2)
    flipped = 1.0 - front * _betacf(b, a, 1.0 - x) / b
    return np.where(x < (a + 1.0) / (a + b + 2.0), direct, flipped)


def welch_p_values(contrast: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of each Welch t (a pandas UDF over the
    contrast table, whose size is the number of subsets)."""
    @F.pandas_udf("double")
    def _p(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(student_t_two_sided_p(t.to_numpy(), d.to_numpy()))

    return contrast.withColumn("p_value", _p(F.col("welch_t"), F.col("welch_df")))
