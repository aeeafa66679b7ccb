"""Error reports and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def worst_predictions(pred: DataFrame, key: str, actual: str, predicted: str = "prediction", k: int = 10,
                      round_prediction: bool = False, extra=()) -> DataFrame:
    """The k largest absolute errors with signed difference and rank.

    ``orderBy(...).limit(k)`` plans as a TakeOrderedAndProject: each task keeps
    its own top k, only k rows per task reach the final merge.
    """
    p = F.bround(F.col(predicted), 0).cast("long") if round_prediction else F.col(predicted)
    d = pred.select(key, *extra, F.col(actual).alias("actual"), p.alias("predicted"))
    d = d.withColumn("diff", F.col("actual") - F.col("predicted")).withColumn("abs_error", F.abs("diff"))
    top = d.orderBy(F.col("abs_error").desc(), F.col(key)).limit(k)
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("abs_error").desc(), F.col(key))))


def flag_membership(df: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """Boolean flag 'key occurs in others' (left join to distinct keys)."""
    ks = others.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(ks, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both results."""
    return a.select(key).intersect(b.select(key))


def tag_union(parts: dict) -> DataFrame:
    """Union by name with a ``split`` tag column."""
    out = None
    for tag, df in parts.items():
        t = df.withColumn("split", F.lit(tag))
        out = t if out is None else out.unionByName(t)
    return out
