"""Sources and sinks.

Parquet is the interchange format; CSV is read with an explicit schema so no
inference pass is paid on large inputs. Sinks refuse to overwrite their own input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame (column pruning/pushdown stay with Catalyst)."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, base_dir: str, names=TABLES) -> None:
    for n in names:
        path = os.path.join(base_dir, f"{n}.parquet")
        if os.path.exists(path):
            read_table(spark, base_dir, n).createOrReplaceTempView(n)


# Hourly log schema (S2): naive timestamps, counts as bigint, codes as double.
HOURLY_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("t1", T.DoubleType()),
    T.StructField("t2", T.DoubleType()),
    T.StructField("hum", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("weather_code", T.DoubleType()),
    T.StructField("is_holiday", T.DoubleType()),
    T.StructField("is_weekend", T.DoubleType()),
    T.StructField("season", T.DoubleType()),
])

# Daily table schema (S6 column order).
DAILY_SCHEMA = T.StructType([
    T.StructField("instant", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("season", T.DoubleType()),
    T.StructField("is_holiday", T.DoubleType()),
    T.StructField("is_weekend", T.DoubleType()),
    T.StructField("working", T.IntegerType()),
    T.StructField("weather_code", T.DoubleType()),
    T.StructField("t1", T.DoubleType()),
    T.StructField("t2", T.DoubleType()),
    T.StructField("hum", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("n_hours_observed", T.IntegerType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV scan with header.

    With a schema no inference job runs; without one, types are inferred (only for
    profiling small files). A UTF-8 byte-order mark is dropped from the header, and
    the reader is multi-byte safe, so BOM-prefixed UTF-8 files with non-Latin text
    read as written.
    """
    reader = (spark.read.option("header", True).option("encoding", "UTF-8")
              .option("timestampFormat", timestamp_format)
              .option("timestampNTZFormat", timestamp_format))
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    # Some readers keep a BOM on the first column name; strip it defensively.
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def _same_path(a: str, b: str) -> bool:
    return os.path.normpath(a.replace("file:", "")) == os.path.normpath(b.replace("file:", ""))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", source_paths=(),
                partition_by=(), mode: str = "overwrite") -> None:
    """Result sink (S4/S7/S8): overwrite, header for CSV, refuse to clobber an input.

    Row order is not kept by distributed writes: callers that care about order
    carry an explicit rank column.
    """
    for src in source_paths:
        if _same_path(src, path):
            raise ValueError(f"refusing to overwrite the input {src}; write derived data elsewhere")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    else:
        w.format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Spark ML persistence."""
    model.write().overwrite().save(path)


def load_model(model_cls, path: str):
    return model_cls.load(path)
