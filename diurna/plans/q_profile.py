"""Registered profile / exploratory queries on lineitem, orders, customer, nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..sources.tables import read_table
from .daily import hourly_log
from .registry import REGISTRY, register

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SPLIT_DATE = "1999-01-01"


def _t(spark, base, name):
    return read_table(spark, base, name)


@register("table_shape", covers=("A1",), sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows, 11 AS n_columns FROM lineitem""")
def q_table_shape(spark, base):
    return profile.shape(_t(spark, base, "lineitem")).select(
        "n_rows", F.col("n_columns").cast("int").alias("n_columns"))


@register("column_types", covers=("A2",), sql="""
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END AS dtype
FROM (DESCRIBE lineitem)""")
def q_column_types(spark, base):
    return profile.column_types(_t(spark, base, "lineitem"))


@register("missing_counts", covers=("A3",), sql="""
WITH j AS (SELECT o.o_orderkey, o.o_totalprice, c.c_acctbal, c.c_mktsegment
           FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
 m AS (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS a,
              count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) AS b,
              count(*) FILTER (WHERE c_acctbal IS NULL OR isnan(c_acctbal)) AS c,
              count(*) FILTER (WHERE c_mktsegment IS NULL) AS d FROM j)
SELECT "column", CAST(missing_count AS BIGINT) AS missing_count FROM m,
 LATERAL (VALUES ('o_orderkey', a), ('o_totalprice', b), ('c_acctbal', c), ('c_mktsegment', d),
                 ('__total__', a + b + c + d)) v("column", missing_count)""")
def q_missing_counts(spark, base):
    """Orders with their customer: customers absent from the table leave NULLs."""
    o = _t(spark, base, "orders")
    c = _t(spark, base, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_totalprice", "c_acctbal",
                                                              "c_mktsegment")
    return profile.missing_counts(j)


def _describe_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count,
  round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std,
  round_even(CAST(min({c}) AS DOUBLE), 6) AS min, round_even(quantile_cont({c}, 0.25), 6) AS q25,
  round_even(quantile_cont({c}, 0.5), 6) AS q50, round_even(quantile_cont({c}, 0.75), 6) AS q75,
  round_even(CAST(max({c}) AS DOUBLE), 6) AS max FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


@register("describe_columns", covers=("A4", "A5", "A16"), sql=_describe_sql(MEASURES))
def q_describe(spark, base):
    return profile.describe(_t(spark, base, "lineitem"), MEASURES, digits=6)


def _iqr_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", round_even(q1, 4) AS "Q1", round_even(q3, 4) AS "Q3",
  round_even(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round_even(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
  CAST((SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT)
    AS outlier_count
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""")
    return "\nUNION ALL\n".join(parts)


@register("iqr_outliers", covers=("A6", "P3"), sql=_iqr_sql(MEASURES))
def q_iqr_outliers(spark, base):
    return profile.iqr_outliers(_t(spark, base, "lineitem"), MEASURES)


@register("preview_head", covers=("A7", "K1"), sql="""
SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice LIMIT 5""")
def q_preview_head(spark, base):
    return profile.preview(_t(spark, base, "lineitem"),
                           ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], 5)


@register("suspect_rows", covers=("A7", "P4"), sql="""
SELECT * FROM lineitem WHERE l_tax = 0""")
def q_suspect_rows(spark, base):
    li = _t(spark, base, "lineitem")
    return li.where(F.col("l_tax") == 0)


@register("group_means_reindexed", covers=("A8", "A9"), sql="""
WITH m AS (SELECT c_nationkey AS n_nationkey, avg(c_acctbal) AS mean_c_acctbal FROM customer
           WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT n.n_nationkey, n.n_name, round_even(m.mean_c_acctbal, 6) AS mean_c_acctbal
FROM nation n LEFT JOIN m ON n.n_nationkey = m.n_nationkey""")
def q_group_means_reindexed(spark, base):
    """Mean balance of one segment per nation, completed to all nations."""
    c = _t(spark, base, "customer").where(F.col("c_mktsegment") == "BUILDING")
    m = profile.group_means(c.withColumnRenamed("c_nationkey", "n_nationkey"), ["n_nationkey"], ["c_acctbal"])
    dom = _t(spark, base, "nation").select("n_nationkey", "n_name")
    out = profile.reindex(m, dom, ["n_nationkey"])
    return out.select("n_nationkey", "n_name", F.bround("mean_c_acctbal", 6).alias("mean_c_acctbal"))


@register("value_counts", covers=("A12", "K1"), sql="""
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count,
       CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS INTEGER) AS rank
FROM orders GROUP BY o_orderpriority""")
def q_value_counts(spark, base):
    return profile.value_counts(_t(spark, base, "orders"), "o_orderpriority").select(
        "o_orderpriority", "count", F.col("rank").cast("int").alias("rank"))


@register("split_category_profile", covers=("A13", "J2", "M2"), sql=f"""
WITH s AS (SELECT o_orderstatus || '/' || CAST(year(o_orderdate) AS VARCHAR) AS status_year,
                  CASE WHEN o_orderdate < TIMESTAMP '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split
           FROM orders)
SELECT status_year,
       CAST(CASE WHEN count(*) FILTER (WHERE split = 'train') > 0 THEN count(*) FILTER (WHERE split = 'train') END AS BIGINT) AS train,
       CAST(CASE WHEN count(*) FILTER (WHERE split = 'test') > 0 THEN count(*) FILTER (WHERE split = 'test') END AS BIGINT) AS test
FROM s GROUP BY status_year""")
def q_split_category_profile(spark, base):
    from ..operators.split import temporal_split
    o = temporal_split(_t(spark, base, "orders"), "o_orderdate", SPLIT_DATE)
    o = o.withColumn("status_year", F.concat_ws("/", "o_orderstatus", F.year("o_orderdate").cast("string")))
    return profile.split_profile(o, "status_year")


def _pivot_sql():
    cols = ",\n  ".join(
        f"round_even(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 6) AS \"{p}\"" for p in PRIORITIES)
    return f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year,\n  {cols}\nFROM orders GROUP BY 1"


@register("pivot_mean", covers=("A17",), sql=_pivot_sql())
def q_pivot_mean(spark, base):
    o = _t(spark, base, "orders").withColumn("year", F.year("o_orderdate"))
    p = profile.pivot_mean(o, "year", "o_orderpriority", PRIORITIES, "o_totalprice")
    return p.select("year", *[F.bround(F.col(f"`{c}`"), 6).alias(c) for c in PRIORITIES])


@register("pivot_extremes", covers=("A18",), sql=f"""
WITH p AS ({_pivot_sql()}),
 v AS (SELECT unnest([{", ".join(f'"{c}"' for c in PRIORITIES)}]) AS v FROM p)
SELECT round_even(min(v), 6) AS cell_min, round_even(max(v), 6) AS cell_max,
       round_even((min(v) + max(v)) / 2, 6) AS cell_mid FROM v""")
def q_pivot_extremes(spark, base):
    p = q_pivot_mean(spark, base)
    e = profile.pivot_extremes(p, "year")
    return e.select(*[F.bround(c, 6).alias(c) for c in e.columns])


@register("correlation_trend", covers=("A19", "A20"), sql="""
SELECT round_even(corr(l_quantity, l_extendedprice), 6) AS pearson_r,
       round_even(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round_even(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       min(l_quantity) AS x_min, max(l_quantity) AS x_max, CAST(count(*) AS BIGINT) AS n
FROM lineitem""")
def q_correlation_trend(spark, base):
    t = profile.correlation_trend(_t(spark, base, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select(*[F.bround(c, 6).alias(c) for c in ("pearson_r", "slope", "intercept")], "x_min", "x_max", "n")


@register("trend_points", covers=("A20",), sql="""
WITH t AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
                  regr_intercept(l_extendedprice, l_quantity) AS intercept,
                  min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem),
 g AS (SELECT CAST(i AS INTEGER) AS point, x_min + (x_max - x_min) * i / 99.0 AS x, slope, intercept
       FROM t, range(100) r(i))
SELECT point, round_even(x, 6) AS x, round_even(slope * x + intercept, 4) AS y FROM g""")
def q_trend_points(spark, base):
    t = profile.correlation_trend(_t(spark, base, "lineitem"), "l_quantity", "l_extendedprice")
    p = profile.trend_points(t, 100)
    return p.select(F.col("point").cast("int").alias("point"), F.bround("x", 6).alias("x"),
                    F.bround("y", 4).alias("y"))


@register("box_stats", covers=("A21",), sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3, count(l_extendedprice) AS n
           FROM lineitem GROUP BY 1),
 f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.l_returnflag, CAST(n AS BIGINT) AS n, round_even(q1, 6) AS q1, round_even(median, 6) AS median,
       round_even(q3, 6) AS q3,
       min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN lo AND hi) AS whisker_low,
       max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN lo AND hi) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN lo AND hi)) AS BIGINT) AS n_fliers
FROM f JOIN lineitem l ON l.l_returnflag = f.l_returnflag
GROUP BY f.l_returnflag, n, q1, median, q3""")
def q_box_stats(spark, base):
    b = profile.box_stats(_t(spark, base, "lineitem"), "l_returnflag", "l_extendedprice")
    return b.select("l_returnflag", "n", *[F.bround(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "whisker_low", "whisker_high", "n_fliers")


@register("box_fliers", covers=("A21",), sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice / l_quantity, 0.25) AS q1,
                  quantile_cont(l_extendedprice / l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
 f AS (SELECT l_returnflag, q1 - 0.45 * (q3 - q1) AS lo, q3 + 0.45 * (q3 - q1) AS hi FROM q)
SELECT l.l_returnflag, l_orderkey, l_linenumber, round_even(l_extendedprice / l_quantity, 6) AS unit_price
FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag
WHERE NOT (l_extendedprice / l_quantity BETWEEN lo AND hi)""")
def q_box_fliers(spark, base):
    """The rows beyond the whiskers of unit prices by return flag (short whiskers, so that there are some)."""
    d = _t(spark, base, "lineitem").withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    out = profile.box_fliers(d, "l_returnflag", "unit_price", whis=0.45)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", F.bround("unit_price", 6).alias("unit_price"))


@register("kde_density", covers=("A22",), sql="""
WITH s AS (SELECT l_linestatus, count(l_quantity) AS n, stddev_samp(l_quantity) AS sd,
                  min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
 s2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM s),
 b AS (SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS x, count(*) AS w FROM lineitem GROUP BY 1, 2),
 g AS (SELECT l_linestatus, n, bw, CAST(i AS INTEGER) AS point,
              lo - 3.0 * bw + (hi - lo + 2 * 3.0 * bw) * i / 199.0 AS grid_x
       FROM s2, range(200) r(i))
SELECT g.l_linestatus, point, round_even(grid_x, 6) AS grid_x,
       round_even(sum(w * exp(-0.5 * ((grid_x - x) / bw) * ((grid_x - x) / bw))) / (n * bw * sqrt(2 * pi())), 6)
         AS density
FROM g JOIN b ON g.l_linestatus = b.l_linestatus GROUP BY g.l_linestatus, point, grid_x, n, bw""")
def q_kde_density(spark, base):
    k = profile.gaussian_kde(_t(spark, base, "lineitem"), "l_quantity", "l_linestatus")
    return k.select("l_linestatus", F.col("point").cast("int").alias("point"), F.bround("grid_x", 6).alias("grid_x"),
                    F.bround("density", 6).alias("density"))


@register("two_sample_contrast", covers=("A28",), sql="""
WITH p AS (
  SELECT o_orderpriority, count(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS n_a,
         avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS mean_a,
         var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS var_a,
         count(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS n_b,
         avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS mean_b,
         var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS var_b
  FROM orders GROUP BY 1
  UNION ALL
  SELECT '__total__', count(o_totalprice) FILTER (WHERE o_orderstatus = 'F'),
         avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'),
         var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F'),
         count(o_totalprice) FILTER (WHERE o_orderstatus = 'O'),
         avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'),
         var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') FROM orders)
SELECT o_orderpriority, CAST(n_a AS BIGINT) AS n_a, round_even(mean_a, 6) AS mean_a,
       CAST(n_b AS BIGINT) AS n_b, round_even(mean_b, 6) AS mean_b,
       round_even((mean_b - mean_a) / mean_a * 100, 6) AS pct_change,
       round_even((mean_b - mean_a) / sqrt(var_a / n_a + var_b / n_b), 6) AS welch_t,
       round_even(pow(var_a / n_a + var_b / n_b, 2) /
         (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)), 6) AS welch_df
FROM p""")
def q_two_sample_contrast(spark, base):
    c = profile.welch_contrast(_t(spark, base, "orders"), "o_totalprice", "o_orderstatus", "F", "O",
                               by="o_orderpriority")
    return c.select("o_orderpriority", "n_a", F.bround("mean_a", 6).alias("mean_a"), "n_b",
                    F.bround("mean_b", 6).alias("mean_b"),
                    *[F.bround(x, 6).alias(x) for x in ("pct_change", "welch_t", "welch_df")])


# The t density integrated from 0 to |t| by Simpson's rule in 2000 steps.
SQL_P = f"""
SELECT c.*, round_even(1 - 2 * k.s, 6) AS p_value FROM ({REGISTRY['two_sample_contrast'].sql}) c
JOIN (SELECT o_orderpriority,
             sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                 * pow(1 + pow(abs(welch_t) * i / 2000, 2) / welch_df, -(welch_df + 1) / 2))
             * max(exp(lgamma((welch_df + 1) / 2) - lgamma(welch_df / 2)) / sqrt(welch_df * pi())
                   * abs(welch_t) / 6000) AS s
      FROM ({REGISTRY['two_sample_contrast'].sql}), range(2001) r(i) GROUP BY o_orderpriority) k
  ON c.o_orderpriority = k.o_orderpriority"""


@register("welch_p_values", covers=("A28",), sql=SQL_P)
def q_welch_p_values(spark, base):
    """The contrast table with two-sided p-values of Student's t."""
    c = profile.welch_p_values(q_two_sample_contrast(spark, base))
    return c.withColumn("p_value", F.bround("p_value", 6))


@register("distinct_sorted", covers=("A29",), sql="""
SELECT l_linestatus, CAST(row_number() OVER (ORDER BY l_linestatus) AS INTEGER) AS position
FROM (SELECT DISTINCT l_linestatus FROM lineitem)""")
def q_distinct_sorted(spark, base):
    d = profile.distinct_sorted(_t(spark, base, "lineitem"), "l_linestatus")
    return d.select("l_linestatus", F.col("position").cast("int").alias("position"))


@register("code_order_check", covers=("A27", "A14"), sql="""
WITH h AS (
  SELECT date_trunc('hour', ts) AS timestamp, CAST(((user_id % 4) + 4) % 4 AS INTEGER) AS series,
         count(*) AS cnt, max(value) AS reading,
         arg_max(CASE event_type WHEN 'error' THEN 7.0::DOUBLE WHEN 'purchase' THEN 7.0::DOUBLE
                   WHEN 'signup' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END, (ts, event_id)) AS code
  FROM events GROUP BY 1, 2),
 hh AS (SELECT *, CAST(hour(timestamp) AS INTEGER) AS hr FROM h),
 m AS (SELECT code, hr, count(*) AS k FROM hh GROUP BY 1, 2)
SELECT a.code, round_even(avg(reading), 6) AS mean_reading, round_even(avg(cnt), 6) AS mean_cnt,
       CAST(count(*) AS BIGINT) AS n_hours,
       (SELECT arg_max(hr, (k, hr)) FROM m WHERE m.code = a.code) AS modal_hour
FROM hh a GROUP BY a.code""")
def q_code_order_check(spark, base):
    """Does the code order follow the readings? mean per code, modal hour, sample size."""
    from ..operators.audit import code_order_check
    h = hourly_log(_t(spark, base, "events")).withColumn("hr", F.hour("timestamp"))
    out = code_order_check(h, "code", ["reading", "cnt"], mode_col="hr")
    return out.select("code", F.bround("mean_reading", 6).alias("mean_reading"),
                      F.bround("mean_cnt", 6).alias("mean_cnt"), "n_hours",
                      F.col("modal_hr").cast("int").alias("modal_hour"))
