"""Model frames derived from the driver tables (shared by several queries).

``line_frame``: one row per lineitem with a unique key, numeric regressors,
calendar parts and the target ``revenue = extendedprice x (1 - discount)``.

``daily_demand``: the daily-demand shape of the original analyses — one row per
ship date with the number of shipped lines (``cnt``), daily mean readings and
calendar attributes. It is a shuffle-by-date aggregate of the whole lineitem
table (partial aggregation first, so a hot date is pre-combined per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..sources.tables import read_table

TEST_FRACTION = 0.2

# lineitem has no declared key; these columns identify a row (full rows are unique).
KEY_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
SQL_KEY_TEXT = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR), "
                "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))")


_SPACE = float(16 ** 15)
LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
                "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")


def _key_text():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in KEY_COLUMNS],
                       F.to_date("l_shipdate").cast("string"),
                       F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))


def line_key():
    """Row key: salted md5 of the identifying columns (same value in SQL via SQL_KEY_TEXT)."""
    return hash_int(_key_text(), "li")


N_FOLDS = 5


def line_frame(spark, base: str, where=None) -> DataFrame:
    """One md5 per row gives the key (digits 1-15), the split (digits 16-30,
    independent bits) and the fold (key mod 5). ``where`` is applied on the raw
    table so it is pushed into the scan."""
    li = read_table(spark, base, "lineitem")
    if where is not None:
        li = li.where(where)
    d = li.select(*LINE_COLUMNS).select("*", F.md5(F.concat(F.lit("li|"), _key_text())).alias("__d"))
    key = F.conv(F.substring("__d", 1, 15), 16, 10).cast("long")
    frac = F.conv(F.substring("__d", 16, 15), 16, 10).cast("long") / F.lit(_SPACE)
    return d.select(
        key.alias("li_key"),
        F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice"),
        F.col("l_returnflag"), F.col("l_linestatus"),
        F.month("l_shipdate").alias("ship_month"), F.year("l_shipdate").alias("ship_year"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.when(frac < TEST_FRACTION, "test").otherwise("train").alias("split"),
        F.pmod(key, F.lit(N_FOLDS)).cast("int").alias("fold"))


def _sql_digits(start: int) -> str:
    return f"CAST(('0x' || substr(__d, {start}, 15))::UBIGINT AS BIGINT)"


# SQL twin of line_frame (oracle side).
SQL_LINE_FRAME = f"""
SELECT {_sql_digits(1)} AS li_key, l_quantity, l_discount, l_tax, l_extendedprice,
       l_returnflag, l_linestatus, CAST(month(l_shipdate) AS INTEGER) AS ship_month,
       CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_extendedprice * (1 - l_discount) AS revenue,
       CASE WHEN CAST({_sql_digits(16)} AS DOUBLE) / {_SPACE} < {TEST_FRACTION} THEN 'test' ELSE 'train' END
         AS split,
       CAST({_sql_digits(1)} % {N_FOLDS} AS INTEGER) AS fold
FROM (SELECT *, md5('li|' || {SQL_KEY_TEXT}) AS __d FROM lineitem)"""


# Two-digit measures of a day: their means come from sums of whole hundredths, the same in any order.
_HUNDREDTHS = (("discount", "discount"), ("tax", "tax"), ("extendedprice", "price"))


def daily_demand(spark, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem")
    d = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("l_quantity").alias("quantity"), *[F.sum(F.round(F.col(f"l_{c}") * 100)).alias(a) for c, a in _HUNDREDTHS],
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return d.select(
        F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
        F.weekday("date").alias("weekday_ord"), F.date_format("date", "EEEE").alias("weekday"),
        F.quarter("date").alias("season"),
        F.when(F.dayofweek("date").isin(1, 7), 1.0).otherwise(0.0).alias("is_weekend"),
        (F.col("quantity") / F.col("cnt")).alias("quantity"),
        *[(F.col(a) / (F.lit(100.0) * F.col("cnt"))).alias(a) for _, a in _HUNDREDTHS], "date", "cnt", "n_returned")


SQL_DAILY_DEMAND = f"""
SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS cnt, CAST(year(CAST(l_shipdate AS DATE)) AS INTEGER) AS year,
       CAST(quarter(CAST(l_shipdate AS DATE)) AS INTEGER) AS season, sum(l_quantity) / count(*) AS quantity,
       {', '.join(f'sum(round(l_{c} * 100)) / (100.0::DOUBLE * count(*)) AS {a}' for c, a in _HUNDREDTHS)}
FROM lineitem GROUP BY ALL"""
