"""Collinearity, dependency, leakage and leverage audits.

Matrix work is split the Spark way: everything that grows with rows is one
distributed aggregate (means, pairwise covariances with Spark's numerically
stable merge), and only the k x k matrix (k = number of regressors) is inverted
on the driver. The per-row leverage is then a plain column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance_matrix(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass: (means, sample covariance k x k, n) over rows with no NULL in ``cols``."""
    cols = list(cols)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs += [F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]
    r = d.agg(*aggs).first()
    k = len(cols)
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] if r[f"c{i}_{j}"] is not None else np.nan
    return np.array([r[f"m{i}"] for i in range(k)], dtype=float), cov, int(r["n"])


def vif(df: DataFrame, cols) -> DataFrame:
    """variance inflation factor of each regressor (model with a constant).

    VIF_j = 1 / (1 - R²_j) equals the j-th diagonal element of the inverse
    correlation matrix.
    """
    cols = list(cols)
    _, cov, _ = covariance_matrix(df, cols)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    inv = np.linalg.pinv(corr)
    rows = [(i, c, float(inv[i, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, VIF double")


def dependency_check(df: DataFrame, target: str, expr, name: str = "rule") -> DataFrame:
    """does ``target`` equal ``expr`` on every row (NULL-safe)?"""
    return df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(~F.col(target).eqNullSafe(expr)).alias("n_violations")) \
        .withColumn("holds", F.col("n_violations") == 0)


def leakage_audit(df: DataFrame, target: str, parts, features, tolerance: float = 1e-9) -> DataFrame:
    """is the target an additive identity of columns that are also features?

    Returns the identity check and the in-sample R² of an OLS fit on ``features``;
    an R² within ``tolerance`` of 1 flags leakage.
    """
    from .models import fit_ols, predict_ols
    from .evaluate import regression_metrics
    ident = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    chk = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~(F.abs(F.col(target) - ident) <= 1e-9)).alias("n_identity_violations"))
    m = fit_ols(df, features, target)
    met = regression_metrics(predict_ols(df, m), target, "prediction")
    out = chk.crossJoin(met.select(F.col("R2").alias("in_sample_R2"), F.col("RMSE").alias("in_sample_RMSE")))
    leak_parts = [p for p in parts if p in features]
    return out.withColumn("parts_in_features", F.lit(",".join(leak_parts))) \
        .withColumn("leakage", (F.col("n_identity_violations") == 0) & F.lit(bool(leak_parts))
                    | (F.col("in_sample_R2") >= 1 - tolerance))


def leverage(df: DataFrame, cols, out_col: str = "leverage", flag_col: str = "high_leverage") -> DataFrame:
    """F8: hat values of an OLS design with intercept and ``cols``; flag h > 2p/n.

    h_i = 1/n + (x_i - x̄)ᵀ S⁻¹ (x_i - x̄) with S the centered scatter matrix. The
    k x k inverse is computed on the driver, the quadratic form per row on the
    executors.
    """
    cols = list(cols)
    means, cov, n = covariance_matrix(df, cols)
    s_inv = np.linalg.pinv(cov * (n - 1))
    dx = [F.col(c).cast("double") - F.lit(float(means[i])) for i, c in enumerate(cols)]
    q = F.lit(1.0 / n)
    for i in range(len(cols)):
        for j in range(len(cols)):
            if s_inv[i, j] != 0:
                q = q + F.lit(float(s_inv[i, j])) * dx[i] * dx[j]
    p = len(cols) + 1
    return df.withColumn(out_col, q).withColumn(flag_col, F.col(out_col) > F.lit(2.0 * p / n))


def constant_in_split(df: DataFrame, cols, split_col: str = "split") -> DataFrame:
    """per split and column, is the column constant (so useless as a feature)?"""
    aggs = []
    for c in cols:
        aggs.append((F.min(c) == F.max(c)).alias(f"{c}"))
    wide = df.groupBy(split_col).agg(*aggs)
    return wide.select(split_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("is_constant")) for c in cols])).alias("v")) \
        .select(split_col, "v.column", "v.is_constant")


def code_order_check(df: DataFrame, code_col: str, measures, mode_col: str | None = None) -> DataFrame:
    """Mean of each measure per code, sample size, and the modal value of
    ``mode_col`` (ties to the larger) — do code numbers follow the readings?"""
    g = df.groupBy(code_col).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures],
                                 F.count(F.lit(1)).alias("n_hours"))
    if mode_col:
        cnt = df.groupBy(code_col, mode_col).agg(F.count(F.lit(1)).alias("__k"))
        mode = cnt.groupBy(code_col).agg(F.max_by(F.col(mode_col), F.struct("__k", mode_col)).alias(f"modal_{mode_col}"))
        g = g.join(mode, code_col)
    return g
