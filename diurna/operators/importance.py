"""Permutation importance, plain and grouped.

A shuffle of a column group within the holdout is a *join*: the rows get dense numbers
0..n-1 in the order of a salted hash of their key, and in repeat r row i takes the
values of row (a_r * i + b_r) mod n, with a_r prime to n. One permutation per repeat
serves all variables, the rule is the same at every size, and no window holds more than
one range partition.

For a linear model only each group's contribution (one number per row) meets the join,
and one aggregate per repeat gives the squared errors of all variables: the join has
rows x repeats rows, not rows x repeats x variables.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.scalar import qcol
from . import trees
from .evaluate import regression_metrics
from .models import FittedModel, OLSModel
from .ranking import global_row_number

_LONG_ROWS = 1 << 31     # up to here a_r * i fits in 64 bits; beyond, decimals give the same numbers


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def permutation_steps(n_repeats: int, salt: str = "perm", n: int | None = None) -> list[tuple[int, int]]:
    """(a_r, b_r) of every repeat: a_r a prime from 2^30 on that does not divide ``n``."""
    out = []
    for r in range(n_repeats):
        h = int(hashlib.md5(f"{salt}|{r}".encode()).hexdigest()[:15], 16)
        a = (1 << 30) + h % (1 << 29)
        while not _is_prime(a) or (n and math.gcd(a, n) != 1):
            a += 1
        out.append((a, h // (1 << 29) % (1 << 30)))
    return out


def _numbered(df: DataFrame, key: str, salt: str) -> tuple[DataFrame, int]:
    """The rows with dense numbers ``__i``, and how many there are."""
    d = global_row_number(df.withColumn("__h", hash_int(qcol(key), salt)), [F.col("__h"), qcol(key)], "__i").drop("__h")
    return d, (d.agg(F.max("__i")).first()[0] or 0) + 1


def _donor(steps, n: int):
    """Array of (repeat, donor number) of a row."""
    kind = "bigint" if n < _LONG_ROWS else "decimal(38,0)"
    at = lambda a, b: ((F.lit(a).cast(kind) * F.col("__i") + F.lit(b).cast(kind)) % F.lit(n).cast(kind)
                       ).cast("long")
    return F.array(*[F.struct(F.lit(r).alias("repeat"), at(a, b).alias("__d")) for r, (a, b) in enumerate(steps)])


def _contribution(model: OLSModel, cols):
    coef = dict(zip(model.features, model.coef))
    return sum((F.lit(float(coef[c])) * qcol(c).cast("double") for c in cols[1:]),
               F.lit(float(coef[cols[0]])) * qcol(cols[0]).cast("double"))


def _linear_r2(df: DataFrame, fitted: FittedModel, target: str, groups: dict, key: str, n_repeats: int,
               salt: str) -> DataFrame:
    """(variable, repeat, R2) of a linear model from one join and one aggregate."""
    m, names = fitted.model, list(groups)
    d, n = _numbered(df.select(qcol(key).alias("__key"), (qcol(target).cast("double") - m.prediction()).alias("__e"),
                               qcol(target).cast("double").alias("__y"),
                               F.array(*[_contribution(m, groups[v]) for v in names]).alias("__c")), "__key", salt)
    taker = d.select("__e", "__y", "__c", F.explode(_donor(permutation_steps(n_repeats, salt, n), n)).alias("to")
                     ).select("__e", "__y", "__c", "to.repeat", "to.__d")
    j = taker.join(d.select(F.col("__i").alias("__d"), F.col("__c").alias("__new")), "__d")
    sse = [F.sum(F.pow(F.col("__e") + F.col("__c")[i] - F.col("__new")[i], 2)) for i in range(len(names))]
    per = j.groupBy("repeat").agg(F.array(*sse).alias("sse"), (F.var_pop("__y") * F.count(F.lit(1))).alias("sst"))
    return per.select("repeat", "sst", F.explode(F.arrays_zip(
        F.array(*[F.lit(v) for v in names]).alias("variable"), "sse")).alias("v")).select(
        "v.variable", "repeat", (1 - F.col("v.sse") / F.col("sst")).alias("R2"))


def permuted_scores(df: DataFrame, fitted: FittedModel, target: str, groups: dict, key: str,
                    n_repeats: int = 30, salt: str = "perm", assignment: DataFrame | None = None) -> DataFrame:
    """Predictions for every (variable, repeat) with that variable's columns shuffled.

    ``assignment`` (variable, repeat, <key>, donor_key) supplies the permutation
    explicitly, e.g. to reproduce a published random stream. Output: variable, repeat,
    target, prediction.
    """
    if assignment is not None:
        return _supplied_scores(df, fitted, target, groups, key, assignment)
    cols = sorted({c for cs in groups.values() for c in cs})
    d, n = _numbered(df, key, salt)
    donors = d.select(F.col("__i").alias("__d"), *[qcol(c).alias(f"__new_{c}") for c in cols])
    takers = d.withColumn("__to", F.explode(_donor(permutation_steps(n_repeats, salt, n), n)))
    j = takers.select("*", "__to.repeat", "__to.__d").drop("__to").join(donors, "__d") \
        .withColumn("variable", F.explode(F.array(*[F.lit(v) for v in groups])))
    return _replaced(j, fitted, target, groups, cols)


def _replaced(j: DataFrame, fitted: FittedModel, target: str, groups: dict, cols) -> DataFrame:
    """Score rows whose variable's columns are taken from the donor's."""
    new = {c: F.when(F.col("variable").isin([v for v, cs in groups.items() if c in cs]), qcol(f"__new_{c}"))
           .otherwise(qcol(c)) for c in cols}
    rest = [qcol(c) for c in j.columns if c not in new and not c.startswith("__")]
    return fitted.transform(j.select(*rest, *[e.alias(c) for c, e in new.items()])).select(
        "variable", "repeat", target, "prediction")


def _supplied_scores(df, fitted, target, groups, key, assignment):
    cols = sorted({c for cs in groups.values() for c in cs})
    donors = df.select(qcol(key).alias("donor_key"), *[qcol(c).alias(f"__new_{c}") for c in cols])
    return _replaced(df.join(assignment, on=key).join(donors, on="donor_key"), fitted, target, groups, cols)


def permutation_importance(df: DataFrame, fitted: FittedModel, target: str, groups: dict, key: str,
                           n_repeats: int = 30, salt: str = "perm",
                           assignment: DataFrame | None = None) -> DataFrame:
    """Mean and population std of the R² drop per variable (group of columns).

    For plain importance pass ``{c: [c] for c in features}``.
    """
    base = regression_metrics(fitted.transform(df), target, "prediction").select(F.col("R2").alias("__base"))
    if isinstance(fitted.model, OLSModel) and assignment is None:
        per = _linear_r2(df, fitted, target, groups, key, n_repeats, salt)
    else:
        sc = permuted_scores(df, fitted, target, groups, key, n_repeats, salt, assignment=assignment)
        per = regression_metrics(sc, target, "prediction", keys=("variable", "repeat"))
    drops = per.crossJoin(F.broadcast(base)).withColumn("drop", F.col("__base") - F.col("R2"))   # one row
    sizes = df.sparkSession.createDataFrame([(v, len(c)) for v, c in groups.items()], "variable string, n_cols int")
    return drops.groupBy("variable").agg(F.avg("drop").alias("importance_mean"),
                                         F.stddev_pop("drop").alias("importance_std")) \
        .join(F.broadcast(sizes), "variable")


def impurity_importance(fitted: FittedModel) -> DataFrame:
    """The tree ensemble's own (impurity gain) importance per feature."""
    from pyspark.sql import SparkSession
    m = fitted.model
    spark = SparkSession.getActiveSession()
    if isinstance(m, trees.Ensemble):
        return trees.gain_importance(trees.split_table(m, spark), fitted.spec.features, fitted.spec.kind)
    imp = m.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(fitted.spec.features, imp)]
    return spark.createDataFrame(rows, "feature string, gain_importance double")


def importance_table(gain: DataFrame, perm: DataFrame) -> DataFrame:
    """Both importances joined by feature *name*, sorted by permutation drop."""
    p = perm.select(F.col("variable").alias("feature"),
                    F.col("importance_mean").alias("permutation_importance_mean_R2_drop"),
                    F.col("importance_std").alias("permutation_importance_std"))
    return gain.join(p, "feature", "full").orderBy(F.col("permutation_importance_mean_R2_drop").desc())
