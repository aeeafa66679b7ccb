"""Repair of missing readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sentinel_to_null
from ..session import cut_lineage


def interpolate_linear(df: DataFrame, col: str, order_by: str, keys=(), sentinel=None,
                       out_col: str | None = None, bucket=None) -> DataFrame:
    """Linear interpolation in row order, equally spaced by *position*.

    A leading gap stays missing, a trailing gap takes the last value, an interior
    gap is filled on the straight line between its two neighbours. ``sentinel``
    (e.g. 0 for an impossible humidity) is turned into NULL first (P5).

    No window holds a whole series: rows are cut into buckets, and only one small row per
    bucket is carried across a series (:func:`interpolate_linear_bucketed`). ``bucket`` is a
    column non-decreasing in ``order_by`` (e.g. the day); without one, the parts of a range
    partitioning by (keys, order_by) are the buckets, checkpointed so that every pass sees
    the same ones.
    """
    if bucket is not None:
        return interpolate_linear_bucketed(df, col, order_by, bucket, keys, sentinel, out_col)
    parts = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], F.col(order_by)).withColumn(
        "__part", F.spark_partition_id()))
    return interpolate_linear_bucketed(parts, col, order_by, "__part", keys, sentinel, out_col).drop("__part")


def interpolate_linear_bucketed(df: DataFrame, col: str, order_by: str, bucket, keys=(), sentinel=None,
                                out_col: str | None = None) -> DataFrame:
    """W1 for arbitrarily long series: same result, no window grows with the series.

    Pass 1 works inside (series, bucket) windows: local positions and the nearest
    known values on both sides within the bucket, plus per-bucket summaries (row
    count, first and last known value). Pass 2 carries those summaries across the
    buckets of a series (one small row per bucket) to give global position
    offsets and the neighbours for gaps that cross bucket borders. Pass 3 joins
    them back and fills.
    """
    out_col = out_col or col
    v = sentinel_to_null(col, sentinel) if sentinel is not None else F.col(col)
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    d = df.withColumn("__v", v).withColumn("__bk", b)
    g = [*keys, "__bk"]
    w = Window.partitionBy(*g).orderBy(order_by)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.withColumn("__lp", F.row_number().over(w))
    known = F.when(F.col("__v").isNotNull(), F.col("__lp"))
    d = (d.withColumn("__lp0", F.last(known, ignorenulls=True).over(back))
         .withColumn("__lv0", F.last("__v", ignorenulls=True).over(back))
         .withColumn("__lp1", F.first(known, ignorenulls=True).over(fwd))
         .withColumn("__lv1", F.first("__v", ignorenulls=True).over(fwd)))
    # one row per bucket: size, first/last known (local position, value)
    kp = F.when(F.col("__v").isNotNull(), F.col("__lp"))
    bk = d.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"), F.min(kp).alias("__fp"), F.max(kp).alias("__lpk"),
                           F.min_by("__v", kp).alias("__fv"), F.max_by("__v", kp).alias("__lvk"))
    wb = Window.partitionBy(*keys).orderBy("__bk") if keys else Window.orderBy("__bk")
    bk = bk.withColumn("__off", F.coalesce(F.sum("__n").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)))
    first_g = F.col("__off") + F.col("__fp")
    last_g = F.col("__off") + F.col("__lpk")
    bk = (bk.withColumn("__cp0", F.last(last_g, ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("__cv0", F.last("__lvk", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("__cp1", F.first(first_g, ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)))
          .withColumn("__cv1", F.first("__fv", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing))))
    same = F.lit(True)
    for i, c in enumerate(g):      # a NULL series is a series
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    d = d.join(bk.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], "__off", "__cp0", "__cv0", "__cp1",
                         "__cv1"), same, "left").drop(*[f"__g{i}" for i in range(len(g))])
    pos = F.col("__off") + F.col("__lp")
    p0 = F.coalesce(F.col("__off") + F.col("__lp0"), F.col("__cp0"))
    v0 = F.when(F.col("__lp0").isNotNull(), F.col("__lv0")).otherwise(F.col("__cv0"))
    p1 = F.coalesce(F.col("__off") + F.col("__lp1"), F.col("__cp1"))
    v1 = F.when(F.col("__lp1").isNotNull(), F.col("__lv1")).otherwise(F.col("__cv1"))
    filled = (F.when(F.col("__v").isNotNull(), F.col("__v"))
              .when(p0.isNull(), F.lit(None))
              .when(p1.isNull(), v0)
              .otherwise(v0 + (v1 - v0) * (pos - p0) / (p1 - p0)))
    d = d.withColumn(out_col, filled.cast("double"))
    return d.drop("__v", "__bk", "__lp", "__lp0", "__lv0", "__lp1", "__lv1", "__off", "__cp0", "__cv0",
                  "__cp1", "__cv1")
