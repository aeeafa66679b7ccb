"""Dense global row numbers without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_row_number(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Number all rows in ``order``: rows are range-partitioned, numbered inside each part, and
    shifted by the sizes of the parts before (one row per part).

    The parts are checkpointed first, so the sizes and the numbers see the same ones.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (parts.withColumn("__inside", inside).join(F.broadcast(before), "__part")   # one row per part
            .withColumn(out, F.col("__before") + F.col("__inside") - 1 + start).drop("__part", "__inside", "__before"))
