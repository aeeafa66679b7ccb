"""Registered source/sink round trips.

Results are written under the shared checkpoint folder (``spark.checkpoint.dir``)
and read back, so the check covers the writer, the schema'd reader and partition
pruning on the way back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models as M
from ..operators import split
from ..session import scratch_path
from ..sources.tables import read_csv, read_table, write_table
from .daily import hourly_log
from .frames import daily_demand, line_frame
from .q_models import OLS2
from .q_rollup import SQL_HOURLY
from .registry import REGISTRY, register

KEEP_YEARS = (1996, 1997)

HOURLY_CSV_SCHEMA = T.StructType([
    T.StructField("series", T.IntegerType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("cnt", T.LongType()), T.StructField("reading", T.DoubleType()),
    T.StructField("code", T.DoubleType())])


@register("csv_roundtrip", covers=("S1", "S2", "S4", "S6"), sql=f"""
SELECT series, timestamp, cnt, reading, code FROM ({SQL_HOURLY})""")
def q_csv_roundtrip(spark, base):
    """Hourly log -> CSV with header -> schema'd scan with naive timestamps."""
    path = scratch_path(spark, f"hourly-csv-{uuid.uuid4().hex}")
    h = hourly_log(read_table(spark, base, "events")).select("series", "timestamp", "cnt", "reading", "code")
    write_table(h, path, fmt="csv", source_paths=[f"{base}/events.parquet"])
    return read_csv(spark, path, HOURLY_CSV_SCHEMA)


@register("year_partitioned_sink", covers=("S4", "S7", "S8"), sql=f"""
SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS BIGINT) AS cnt, CAST(year(l_shipdate) AS INTEGER) AS year
FROM lineitem WHERE year(l_shipdate) IN {KEEP_YEARS} GROUP BY 1, 3""")
def q_year_partitioned_sink(spark, base):
    """Daily table written partitioned by year; reading two years prunes the rest."""
    path = scratch_path(spark, f"daily-by-year-{uuid.uuid4().hex}")
    d = daily_demand(spark, base).select("date", "cnt", "year")
    write_table(d, path, partition_by=("year",), source_paths=[f"{base}/lineitem.parquet"])
    back = spark.read.parquet(path).where(F.col("year").isin(*KEEP_YEARS))
    return back.select("date", "cnt", F.col("year").cast("int").alias("year"))


@register("csv_bom_roundtrip", covers=("S3",), sql=f"""
SELECT series, '시간 ' || CAST(hour(timestamp) AS VARCHAR) AS label, CAST(cnt AS BIGINT) AS cnt FROM ({SQL_HOURLY})""")
def q_csv_bom(spark, base):
    """A file with a byte-order mark before its header and non-Latin text, read as written."""
    path = scratch_path(spark, f"hourly-bom-{uuid.uuid4().hex}")
    h = hourly_log(read_table(spark, base, "events")).select(
        F.col("series").alias("\ufeffseries"), F.concat(F.lit("시간 "), F.hour("timestamp").cast("string")).alias("label"),
        "cnt")
    write_table(h, path, fmt="csv", source_paths=[f"{base}/events.parquet"])
    back = read_csv(spark, path)
    return back.select(F.col("series").cast("int").alias("series"), "label", F.col("cnt").cast("long").alias("cnt"))


@register("model_roundtrip", covers=("S5",), sql=REGISTRY["ols_coefficients"].sql)
def q_model_roundtrip(spark, base):
    """A fitted model written as JSON, read back, and its coefficients."""
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    m = M.fit_ols(split.part(line_frame(spark, base), "train"), OLS2.features, "revenue")
    spark.createDataFrame([(m.to_json(),)], "value string").write.text(path)
    back = M.OLSModel.from_json(spark.read.text(path).first()["value"])
    return back.coefficients(spark).select("position", "feature", F.bround("coef", 4).alias("coef"))


@register("overwrite_refused", covers=("S8",), sql="""
SELECT TRUE AS refused, count(*) AS n_rows_left, sum(l_orderkey * 31 + l_linenumber)::BIGINT AS checksum FROM lineitem""")
def q_overwrite_refused(spark, base):
    """Writing to an input's own path is refused and leaves it as it is; the input is a copy of all lines made for this."""
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    write_table(read_table(spark, base, "lineitem").select("l_orderkey", "l_linenumber"), path,
                source_paths=[f"{base}/lineitem.parquet"])
    copy = spark.read.parquet(path)
    try:
        write_table(copy.where("false"), path, source_paths=[path])
        refused = False
    except ValueError:
        refused = True
    left = spark.read.schema(copy.schema).parquet(path)
    return left.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n_rows_left"),
                    F.sum(F.col("l_orderkey") * 31 + F.col("l_linenumber")).cast("long").alias("checksum"))
