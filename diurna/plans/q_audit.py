"""Registered audit, encoding and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import label_of, sentinel_to_null
from ..operators import audit, encode, report, split
from ..sources.tables import read_table
from .frames import SQL_LINE_FRAME, line_frame
from .registry import register

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("vif_audit", covers=("F5",), sql=f"""
WITH d AS ({SQL_LINE_FRAME}),
 r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, revenue) AS b,
              corr(l_extendedprice, revenue) AS c FROM d),
 v AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT * FROM (
  SELECT 0 AS position, 'l_quantity' AS feature, round_even((1 - c * c) / det, 4) AS "VIF" FROM v
  UNION ALL SELECT 1, 'l_extendedprice', round_even((1 - b * b) / det, 4) FROM v
  UNION ALL SELECT 2, 'revenue', round_even((1 - a * a) / det, 4) FROM v)""")
def q_vif(spark, base):
    v = audit.vif(line_frame(spark, base), ["l_quantity", "l_extendedprice", "revenue"])
    return v.select("position", "feature", F.bround("VIF", 4).alias("VIF"))


@register("dependency_check", covers=("F6",), sql="""
SELECT 'linestatus_from_returnflag' AS rule, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM
            CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END) AS BIGINT) AS n_violations,
       count(*) FILTER (WHERE l_linestatus IS DISTINCT FROM
            CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END) = 0 AS holds
FROM lineitem""")
def q_dependency_check(spark, base):
    li = read_table(spark, base, "lineitem")
    rule = F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    return audit.dependency_check(li, "l_linestatus", rule, "linestatus_from_returnflag")


@register("leakage_audit", covers=("F7", "M4", "M9"), sql=f"""
WITH d AS (SELECT l_extendedprice AS total, revenue AS net, l_extendedprice * l_discount AS disc_amt
           FROM ({SQL_LINE_FRAME})),
 m AS (SELECT avg(net) AS mx1, avg(disc_amt) AS mx2, avg(total) AS my,
              covar_samp(net, net) AS s11, covar_samp(net, disc_amt) AS s12, covar_samp(disc_amt, disc_amt) AS s22,
              covar_samp(net, total) AS s1y, covar_samp(disc_amt, total) AS s2y FROM d),
 b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
              (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
 p AS (SELECT total, my - b1 * mx1 - b2 * mx2 + b1 * net + b2 * disc_amt AS pred FROM d, b)
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST((SELECT count(*) FROM d WHERE NOT abs(total - (net + disc_amt)) <= 1e-9) AS BIGINT) AS n_identity_violations,
       round_even(1 - sum((total - pred) * (total - pred)) / (var_pop(total) * count(*)), 6) AS in_sample_R2,
       'net,disc_amt' AS parts_in_features, true AS leakage
FROM p""")
def q_leakage_audit(spark, base):
    d = line_frame(spark, base).select(F.col("l_extendedprice").alias("total"), F.col("revenue").alias("net"),
                                       (F.col("l_extendedprice") * F.col("l_discount")).alias("disc_amt"))
    a = audit.leakage_audit(d, "total", ["net", "disc_amt"], ["net", "disc_amt"])
    return a.select("n_rows", "n_identity_violations", F.bround("in_sample_R2", 6).alias("in_sample_R2"),
                    "parts_in_features", "leakage")


@register("leverage_flags", covers=("F8",), sql=f"""
WITH d AS ({SQL_LINE_FRAME}),
 m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2,
              covar_samp(l_quantity, l_quantity) * (count(*) - 1) AS s11,
              covar_samp(l_quantity, l_discount) * (count(*) - 1) AS s12,
              covar_samp(l_discount, l_discount) * (count(*) - 1) AS s22 FROM d),
 i AS (SELECT *, s22 / (s11 * s22 - s12 * s12) AS i11, -s12 / (s11 * s22 - s12 * s12) AS i12,
              s11 / (s11 * s22 - s12 * s12) AS i22 FROM m),
 h AS (SELECT li_key, 1.0 / n + i11 * (l_quantity - m1) * (l_quantity - m1)
              + 2 * i12 * (l_quantity - m1) * (l_discount - m2) + i22 * (l_discount - m2) * (l_discount - m2) AS lev,
              2.0 * 3 / n AS cut FROM d, i)
SELECT li_key, round_even(lev, 9) AS leverage, lev > cut AS high_leverage FROM h""")
def q_leverage(spark, base):
    d = line_frame(spark, base)
    h = audit.leverage(d, ["l_quantity", "l_discount"])
    return h.select("li_key", F.bround("leverage", 9).alias("leverage"), "high_leverage")


def _onehot_sql():
    pr = ",\n  ".join(f"CASE WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderpriority_{p}\""
                      for p in PRIORITIES[1:])
    st = ",\n  ".join(f"CASE WHEN o_orderstatus = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"o_orderstatus_{s}\""
                      for s in ["O", "P"])
    return f"SELECT o_orderkey, o_totalprice,\n  {pr},\n  {st}\nFROM orders"


@register("one_hot_design", covers=("F1", "P1", "P2"), sql=_onehot_sql())
def q_one_hot(spark, base):
    o = read_table(spark, base, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out, _ = encode.one_hot(o, ["o_orderpriority", "o_orderstatus"])
    return out


@register("one_hot_union_levels", covers=("F2", "J6", "M2"), sql=f"""
WITH d AS ({SQL_LINE_FRAME}),
 lv AS (SELECT min(ship_year) AS y0, count(DISTINCT ship_year) AS k FROM d)
SELECT li_key, CASE WHEN ship_year < 2000 THEN 'train' ELSE 'test' END AS split,
       CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_N",
       CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_R",
       CASE WHEN ship_year > y0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS year_dummy_sum,
       CAST(k - 1 AS BIGINT) AS n_year_dummies
FROM d, lv""")
def q_one_hot_union(spark, base):
    """Train (before 2000) and test encoded alike, with levels from both: the test-only years
    keep their dummies."""
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    train = line_frame(spark, base, F.col("l_shipdate") < cut)
    test = line_frame(spark, base, F.col("l_shipdate") >= cut)
    lv = encode.union_levels([train, test], ["l_returnflag", "ship_year"])
    cats = ["l_returnflag", "ship_year"]
    parts = {name: encode.one_hot(d.drop("split"), cats, level_map=lv) for name, d in (("train", train), ("test", test))}
    out = report.tag_union({name: p[0] for name, p in parts.items()})
    years = [n for n in parts["test"][1] if n.startswith("ship_year_")]
    return out.select("li_key", "split", "l_returnflag_N", "l_returnflag_R",
                      sum((F.col(y) for y in years[1:]), F.col(years[0])).alias("year_dummy_sum"),
                      F.lit(len(years)).cast("long").alias("n_year_dummies"))


@register("ordinal_design", covers=("F3", "P11"), sql="""
SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday_ord,
       CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice FROM orders""")
def q_ordinal_design(spark, base):
    o = read_table(spark, base, "orders")
    o = o.withColumn("weekday", F.date_format("o_orderdate", "EEEE"))
    o = encode.ordinal_weekday(o)
    return o.select("o_orderkey", F.col("weekday_ord").cast("int").alias("weekday_ord"),
                    F.month("o_orderdate").alias("month"), "o_totalprice")


@register("constant_in_split", covers=("F9", "M2"), sql="""
WITH s AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split,
                  CAST(year(o_orderdate) >= 1999 AS INTEGER) AS late, o_orderstatus AS status FROM orders)
SELECT split, "column", is_constant FROM (
  SELECT split, 'late' AS "column", min(late) = max(late) AS is_constant FROM s GROUP BY split
  UNION ALL
  SELECT split, 'status', min(status) = max(status) FROM s GROUP BY split)""")
def q_constant_in_split(spark, base):
    o = split.temporal_split(read_table(spark, base, "orders"), "o_orderdate", "1999-01-01")
    o = o.withColumn("late", (F.year("o_orderdate") >= 1999).cast("int")).withColumn("status", F.col("o_orderstatus"))
    return audit.constant_in_split(o, ["late", "status"])


@register("hash_split", covers=("M1", "J9"), sql=f"""
SELECT li_key, split FROM ({SQL_LINE_FRAME})""")
def q_hash_split(spark, base):
    return line_frame(spark, base).select("li_key", "split")


@register("exact_size_split", covers=("M1",), sql="""
WITH h AS (SELECT o_orderkey,
             CAST(('0x' || substr(md5('split|' || CAST(o_orderkey AS VARCHAR)), 1, 15))::UBIGINT AS BIGINT) >> 8 AS sh
           FROM orders),
 r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sh) AS rn, count(*) OVER () AS n FROM h)
SELECT o_orderkey, CASE WHEN rn <= ceil(0.2 * n - 1e-9) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_exact_size_split(spark, base):
    """80/20 split of orders with an exact test size (ceil(0.2 n) rows)."""
    o = read_table(spark, base, "orders").select("o_orderkey")
    return split.hash_split(o, "o_orderkey", 0.2, exact_size=True)


@register("exact_size_folds", covers=("M3",), sql="""
WITH h AS (SELECT o_orderkey,
             CAST(('0x' || substr(md5('fold|' || CAST(o_orderkey AS VARCHAR)), 1, 15))::UBIGINT AS BIGINT) >> 8 AS sh
           FROM orders),
 r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sh) - 1 AS rk, count(*) OVER () AS n FROM h),
 f AS (SELECT o_orderkey, rk, n, n // 5 AS q, n % 5 AS rem FROM r)
SELECT o_orderkey,
       CAST(CASE WHEN rk < rem * (q + 1) THEN rk // (q + 1) ELSE rem + (rk - rem * (q + 1)) // q END AS INTEGER)
         AS fold
FROM f""")
def q_exact_size_folds(spark, base):
    """Five folds of orders with the exact sizes of a shuffled k-fold."""
    o = read_table(spark, base, "orders").select("o_orderkey")
    return split.kfold(o, "o_orderkey", 5, exact_sizes=True)


@register("kfold_sizes", covers=("M3", "J3"), sql=f"""
SELECT fold, CAST(count(*) AS BIGINT) AS n, round_even(avg(revenue), 4) AS mean_revenue
FROM ({SQL_LINE_FRAME}) WHERE split = 'train' GROUP BY fold""")
def q_kfold_sizes(spark, base):
    d = split.part(line_frame(spark, base), "train")
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("revenue"), 4).alias("mean_revenue"))


@register("temporal_split", covers=("M2",), sql="""
SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS split,
       CAST(count(*) AS BIGINT) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
FROM orders GROUP BY 1""")
def q_temporal_split(spark, base):
    o = split.temporal_split(read_table(spark, base, "orders"), "o_orderdate", "1999-01-01")
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_date"),
                                  F.max("o_orderdate").alias("last_date"))


@register("calendar_keys", covers=("P9", "P10", "P11", "P14", "P6"), sql="""
SELECT o_orderkey, strftime(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT),
         CAST(day(o_orderdate) AS BIGINT)), '%Y-%m-%d') AS iso_date,
       dayname(o_orderdate) AS weekday, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday_ord,
       CAST(trunc(o_totalprice) AS BIGINT) AS price_floor
FROM orders""")
def q_calendar_keys(spark, base):
    from ..functions.scalar import iso_date, weekday_name, weekday_name_to_ordinal
    o = read_table(spark, base, "orders")
    o = o.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
                 F.dayofmonth("o_orderdate").alias("d"), weekday_name("o_orderdate").alias("weekday"),
                 "o_totalprice")
    return o.select("o_orderkey", iso_date("y", "m", "d").alias("iso_date"), "weekday",
                    weekday_name_to_ordinal("weekday").cast("int").alias("weekday_ord"),
                    F.col("o_totalprice").cast("long").alias("price_floor"))


PRIORITY_LABELS = {"1-URGENT": "urgent", "2-HIGH": "high"}


@register("code_labels", covers=("P13",), sql="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
       ELSE o_orderpriority END AS label FROM orders""")
def q_code_labels(spark, base):
    """Codes to labels; a code without one shows as itself."""
    o = read_table(spark, base, "orders")
    return o.select("o_orderkey", label_of("o_orderpriority", PRIORITY_LABELS).alias("label"))


@register("sentinel_to_null", covers=("P5", "A3"), sql=f"""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (l_discount = 0) AS BIGINT) AS n_missing,
       round_even(avg(nullif(l_discount, 0)), 6) AS mean_known
FROM ({SQL_LINE_FRAME}) GROUP BY l_returnflag""")
def q_sentinel(spark, base):
    """Zero discounts read as missing, then counted and left out of the mean."""
    d = line_frame(spark, base).withColumn("v", sentinel_to_null("l_discount", 0.0))
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"),
                                         F.bround(F.avg("v"), 6).alias("mean_known"))


FAMILIES = {"linear": ("l_quantity", "l_discount"), "tree": ("l_quantity", "l_discount", "l_tax")}


@register("feature_sets", covers=("F4", "F10"), sql="""
SELECT 'linear' AS family, 0 AS position, 'l_quantity' AS feature, CAST(count(l_quantity) AS BIGINT) AS n FROM lineitem
UNION ALL SELECT 'linear', 1, 'l_discount', count(l_discount) FROM lineitem
UNION ALL SELECT 'tree', 0, 'l_quantity', count(l_quantity) FROM lineitem
UNION ALL SELECT 'tree', 1, 'l_discount', count(l_discount) FROM lineitem
UNION ALL SELECT 'tree', 2, 'l_tax', count(l_tax) FROM lineitem
UNION ALL SELECT 'refused', 0, 'l_linestatus', count(l_linestatus) FROM lineitem""")
def q_feature_sets(spark, base):
    """One feature set per model family with its known values; a diagnostic column is refused."""
    diagnostics = ("l_linestatus",)
    rows = [(f, i, c) for f, cols in FAMILIES.items()
            for i, c in enumerate(encode.FeatureSet(f, cols, diagnostics).columns)]
    try:
        encode.FeatureSet("bad", ("l_tax", "l_linestatus"), diagnostics)
    except ValueError:
        rows.append(("refused", 0, "l_linestatus"))
    li = read_table(spark, base, "lineitem")
    cols = sorted({c for _, _, c in rows})
    known = li.agg(*[F.count(c).alias(c) for c in cols]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in cols])).alias("v")).select("v.*")
    return spark.createDataFrame(rows, "family string, position int, feature string").join(known, "feature").select(
        "family", "position", "feature", "n")
