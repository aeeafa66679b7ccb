"""Feature encoding.

Levels of a categorical column are the distinct values of that column (one distinct
aggregate; a column is made of them, so they reach the driver however many); the dummies themselves are plain
``when`` expressions evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import qcol, weekday_name_to_ordinal


@dataclass(frozen=True)
class FeatureSet:
    """a named list of feature columns for one model family; diagnostics are refused."""
    name: str
    columns: tuple
    diagnostics: tuple = ()

    def __post_init__(self):
        check_features(self.columns, self.diagnostics)


def check_features(features, diagnostics=()) -> None:
    """diagnostic columns (quality flags, coverage counts) are never features."""
    bad = sorted(set(features) & set(diagnostics))
    if bad:
        raise ValueError(f"diagnostic columns used as features: {bad}")


def level_label(v) -> str:
    """Dummy-name text of a level: floats keep their '.0' (``weather_code_26.0``)."""
    return repr(float(v)) if isinstance(v, float) else str(v)


def levels(df: DataFrame, col: str) -> list:
    """Sorted distinct non-NULL values (numeric order for numbers)."""
    return sorted(r[0] for r in df.select(qcol(col)).where(qcol(col).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, cols, level_map: dict | None = None, drop_first: bool = True,
            keep_source: bool = False) -> tuple[DataFrame, list[str]]:
    """dummy columns ``{col}_{level}``; the smallest level is dropped.

    ``level_map`` fixes the levels (e.g. from train ∪ test, F2) so a level seen
    only on one side still gets its column; otherwise levels come from ``df``.
    Returns the frame and the dummy column names in order.
    """
    names, dummies = [], []
    for c in cols:
        lv = list(level_map[c]) if level_map and c in level_map else levels(df, c)
        for v in lv[1:] if drop_first else lv:
            names.append(f"{c}_{level_label(v)}")
            dummies.append(F.when(qcol(c) == F.lit(v), 1.0).otherwise(0.0).alias(names[-1]))
    kept = [qcol(c) for c in df.columns if keep_source or c not in cols]
    return df.select(*kept, *dummies), names


def union_levels(frames, cols) -> dict:
    """levels over several frames (train ∪ test) in one distinct pass per column."""
    u = frames[0].select(*cols)
    for f in frames[1:]:
        u = u.unionByName(f.select(*cols))
    return {c: levels(u, c) for c in cols}


def ordinal_weekday(df: DataFrame, col: str = "weekday", out: str = "weekday_ord") -> DataFrame:
    """weekday name -> Monday=0 ordinal."""
    return df.withColumn(out, weekday_name_to_ordinal(col))


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """Feature vector for pyspark.ml estimators (NULLs are an error, not a silent drop)."""
    cast = df.select("*", *[qcol(f).cast(T.DoubleType()).alias(f"__f_{i}") for i, f in enumerate(features)])
    va = VectorAssembler(inputCols=[f"__f_{i}" for i in range(len(features))], outputCol=out,
                         handleInvalid="error")
    return va.transform(cast).drop(*[f"__f_{i}" for i in range(len(features))])
