"""Row splits.

Assignments are functions of the row key (salted md5), so they are identical on
every run, under any partitioning, after executor loss and task retries, and can
be recomputed by any SQL engine. ``randomSplit`` gives none of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_fraction, hash_int


def hash_split(df: DataFrame, key, test_fraction: float = 0.2, salt: str = "split",
               col: str = "split", exact_size: bool = False) -> DataFrame:
    """M1: 'test' for rows whose key hashes below ``test_fraction``, else 'train'.

    With ``exact_size`` the test part has exactly ceil(test_fraction x n) rows (as
    a shuffled 80/20 split does: 147 of 731): the rows with the smallest hashes,
    cut at an exact order statistic computed with bounded memory. The key must then be
    unique, which is checked.
    """
    if not exact_size:
        return df.withColumn(col, F.when(hash_fraction(key, salt) < F.lit(test_fraction), F.lit("test"))
                             .otherwise(F.lit("train")))
    import math
    from .profile import order_statistic
    h = F.shiftright(hash_int(key, salt), 8).cast("double")    # 52 bits: exact as a double
    d = df.withColumn("__sh", h)
    n = d.count()
    k = math.ceil(test_fraction * n - 1e-9)
    if k <= 0:
        return d.drop("__sh").withColumn(col, F.lit("train"))
    cut = order_statistic(d, "__sh", k - 1)
    _check_size(d, cut, k, key)
    return d.withColumn(col, F.when(F.col("__sh") <= F.lit(cut), F.lit("test")).otherwise(F.lit("train"))) \
        .drop("__sh")


def _check_size(d: DataFrame, cut: float, size: int, key) -> None:
    """Exact sizes need a key of one row: rows of one key can't be parted."""
    got = d.where(F.col("__sh") <= F.lit(cut)).count()
    if got != size:
        raise ValueError(f"{got} rows instead of {size}: the key {key} repeats; use a key of one row")


def temporal_split(df: DataFrame, time_col: str, cut, col: str = "split") -> DataFrame:
    """M2: tag rows before ``cut`` train, the rest test (use :func:`temporal_train_test`
    when only one side is needed: its filters reach the scan)."""
    return df.withColumn(col, F.when(F.col(time_col) < F.lit(cut).cast(df.schema[time_col].dataType),
                                     F.lit("train")).otherwise(F.lit("test")))


def temporal_train_test(df: DataFrame, time_col: str, cut) -> tuple[DataFrame, DataFrame]:
    """M2 as two filtered frames whose predicates reach the Parquet scan
    (``PushedFilters``), so each side reads only its own row groups.
    Rows with a NULL time go to the test side, as with :func:`temporal_split`."""
    c = F.col(time_col)
    lit = F.lit(cut).cast(df.schema[time_col].dataType)
    return df.where(c < lit), df.where((c >= lit) | c.isNull())


def kfold(df: DataFrame, key, k: int = 5, salt: str = "fold", col: str = "fold",
          exact_sizes: bool = False) -> DataFrame:
    """M3: fold id in [0, k) from the key hash.

    With ``exact_sizes`` folds are consecutive runs of the hash order with the sizes
    of a shuffled k-fold (n // k, the first n % k folds one larger: 73, 73, 72, 72,
    72 for 362 rows); the k - 1 cut points are exact order statistics found in one
    bounded-memory pass.
    """
    if not exact_sizes:
        return df.withColumn(col, hash_bucket(key, k, salt))
    from .profile import exact_quantiles
    d = df.withColumn("__sh", F.shiftright(hash_int(key, salt), 8).cast("double"))
    n = d.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    ends, acc = [], 0
    for s in sizes[:-1]:
        acc += s
        ends.append(acc - 1)                       # 0-based rank of each fold's last row
    ends = [e for e in ends if e >= 0]
    cuts = sorted(float(r["value"]) for r in exact_quantiles(d, "__sh", [], ranks=ends).collect()) if ends else []
    for end, c in zip(ends, cuts):
        _check_size(d, c, end + 1, key)
    fold = sum((F.col("__sh") > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    return d.withColumn(col, fold.cast("int")).drop("__sh")


def with_assignment(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """M1/M3 with an external table (key -> split/fold), e.g. to reproduce a
    published random assignment. The assignment has one row per key."""
    return df.join(assignment, on=key, how="inner")


def part(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    """The rows of one part (a pushed-down filter on the tag)."""
    return df.where(F.col(col) == F.lit(name))
