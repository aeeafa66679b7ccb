"""The incremental roll-up gives the same daily table as the batch roll-up."""

import datetime as dt
import uuid

from diurna.operators.rollup import daily_rollup
from diurna.session import scratch_path
from diurna.sources.tables import HOURLY_LOG_SCHEMA
from diurna.streaming.rollup_stream import start_daily_rollup
from tests.test_rollup import SPEC


def _hours(day, hours, code):
    return [(dt.datetime(2015, 1, day, h), 10, 5.0, 4.0, 80.0, 3.0, float(code), 0.0, 0.0, 3.0) for h in hours]


def test_stream_matches_batch(spark):
    src = scratch_path(spark, f"stream-src-{uuid.uuid4().hex}")
    out = scratch_path(spark, f"stream-out-{uuid.uuid4().hex}")
    ck = scratch_path(spark, f"stream-ck-{uuid.uuid4().hex}")
    first = spark.createDataFrame(_hours(5, range(0, 12), 1) + _hours(6, range(0, 3), 7), HOURLY_LOG_SCHEMA)
    first.write.mode("append").parquet(src)
    start_daily_rollup(spark, src, HOURLY_LOG_SCHEMA, SPEC, out, ck).awaitTermination()
    # the rest of day 6 arrives later: its severity must be recomputed from all its hours
    later = spark.createDataFrame(_hours(6, range(3, 8), 7) + _hours(7, range(0, 24), 2), HOURLY_LOG_SCHEMA)
    later.write.mode("append").parquet(src)
    start_daily_rollup(spark, src, HOURLY_LOG_SCHEMA, SPEC, out, ck).awaitTermination()
    streamed = spark.read.parquet(out)
    batch = daily_rollup(spark.read.parquet(src), SPEC)
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert streamed.count() == 3
    assert {r["date"].day: r["weather_code"] for r in streamed.collect()} == {5: 1.0, 6: 7.0, 7: 2.0}


def test_a_batch_of_one_series_keeps_the_others(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from diurna.streaming.rollup_stream import refresh_days
    spec = replace(SPEC, keys=("series",))
    out = scratch_path(spark, f"stream-two-{uuid.uuid4().hex}")
    day = spark.createDataFrame(_hours(5, range(0, 12), 1), HOURLY_LOG_SCHEMA)
    store = day.withColumn("series", F.lit(0)).unionByName(day.withColumn("series", F.lit(1)))
    refresh_days(spark, store, store, spec, out)
    refresh_days(spark, store.where("series = 0"), store, spec, out)
    assert {r["series"] for r in spark.read.parquet(out).collect()} == {0, 1}
