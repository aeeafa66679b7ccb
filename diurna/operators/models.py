"""Regressors.

OLS is fitted the distributed way: one aggregate produces the means and the
k x k (co)variance sums, the k x k system is solved on the driver with a
pseudo-inverse (minimum-norm solution when dummies are collinear), and
prediction is a column expression — no Python on the executors. Cross-validation
folds come out of the *same* single pass: per-fold sums are aggregated once and
each fold's training sums are "all minus the fold".

Forest and boosted trees are grown by ``trees`` from exact partial sums; the factories of the
``pyspark.ml`` estimators serve pipelines that want those (``engine="ml"``).
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import qcol

from . import trees
from .encode import assemble


@dataclass
class OLSModel:
    features: list
    coef: np.ndarray
    intercept: float
    n: int = 0

    def prediction(self) -> Column:
        e = F.lit(float(self.intercept))
        for f, b in zip(self.features, self.coef):
            e = e + F.lit(float(b)) * qcol(f).cast("double")
        return e

    def coefficients(self, spark) -> DataFrame:
        """Intercept first, then one row per feature, with position."""
        rows = [(0, "intercept", float(self.intercept))] + [
            (i + 1, f, float(b)) for i, (f, b) in enumerate(zip(self.features, self.coef))]
        return spark.createDataFrame(rows, "position int, feature string, coef double")

    def to_json(self) -> str:
        return json.dumps({"features": list(self.features), "coef": [float(x) for x in self.coef],
                           "intercept": float(self.intercept), "n": self.n})

    @staticmethod
    def from_json(s: str) -> "OLSModel":
        d = json.loads(s)
        return OLSModel(d["features"], np.array(d["coef"]), d["intercept"], d.get("n", 0))


def _solve(mean: np.ndarray, com: np.ndarray) -> tuple[np.ndarray, float]:
    """Minimum-norm OLS from the means and co-moment matrix of (x_1..x_k, y)."""
    k = len(mean) - 1
    cxx, cxy = com[:k, :k], com[:k, k]
    b = np.linalg.pinv(cxx, rcond=1e-10, hermitian=True) @ cxy
    return b, float(mean[k] - mean[:k] @ b)


def _moment_aggs(features, target):
    """n, means and population covariances of (features, target): Spark merges
    these partial aggregates with its numerically stable pairwise update."""
    z = [qcol(c).cast("double") for c in [*features, target]]
    m = len(z)
    missing = F.lit(False)
    for c in z:
        missing = missing | c.isNull() | F.isnan(c)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing")] + [F.avg(z[i]).alias(f"m{i}") for i in range(m)]
    aggs += [F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]
    return aggs


def _moments_from_row(r, m):
    n = int(r["n"])
    if r["missing"]:
        raise ValueError(f"{r['missing']} rows have NULL or NaN features or target; drop or fill them first")
    mean = np.array([r[f"m{i}"] for i in range(m)], dtype=float)
    com = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            com[i, j] = com[j, i] = r[f"c{i}_{j}"] * n
    return n, mean, com


def _merge(a, b):
    """Combine (n, mean, co-moment) of two disjoint row sets (Chan et al.)."""
    na, ma, ca = a
    nb, mb, cb = b
    n = na + nb
    d = mb - ma
    return n, ma + d * (nb / n), ca + cb + np.outer(d, d) * (na * nb / n)


def fit_ols(df: DataFrame, features, target: str) -> OLSModel:
    """M4: OLS with intercept, minimum-norm coefficients; one aggregate pass.

    NULL or NaN in a feature or the target is an error (counted in the same pass)."""
    features = list(features)
    r = df.agg(*_moment_aggs(features, target)).first()
    n, mean, com = _moments_from_row(r, len(features) + 1)
    b, a = _solve(mean, com)
    return OLSModel(features, b, a, n)


def fold_moments(df: DataFrame, features, target: str, fold_col: str = "fold") -> dict:
    """Per fold the moments (n, mean, co-moments) of features and target, in one pass."""
    features = list(features)
    rows = df.groupBy(fold_col).agg(*_moment_aggs(features, target)).collect()
    return {r[fold_col]: _moments_from_row(r, len(features) + 1) for r in rows}


def others_moments(per: dict, fold):
    """Moments of all folds but one."""
    acc = None
    for g, mom in per.items():
        if g != fold:
            acc = mom if acc is None else _merge(acc, mom)
    return acc


def moments_r2(mom, model: "OLSModel") -> float:
    """R² of a linear model on the rows that the moments describe; no pass over them."""
    n, mean, com = mom
    k = len(mean) - 1
    b = np.asarray(model.coef)
    off = mean[k] - model.intercept - mean[:k] @ b
    sse = com[k, k] - 2 * b @ com[:k, k] + b @ com[:k, :k] @ b + n * off * off
    return float(1.0 - sse / com[k, k]) if com[k, k] else float("nan")


def fit_ols_folds(df: DataFrame, features, target: str, fold_col: str = "fold") -> dict:
    """One pass, k fits: per-fold moments, training moments = merge of the other folds."""
    return ols_by_fold(fold_moments(df, features, target, fold_col), list(features))


def ols_by_fold(per: dict, features: list) -> dict:
    models = {}
    for f in per:
        n, mean, com = others_moments(per, f)
        b, a = _solve(mean, com)
        models[f] = OLSModel(features, b, a, int(n))
    return models


def predict_ols(df: DataFrame, model: OLSModel, out: str = "prediction") -> DataFrame:
    """M8 for OLS: a JVM-side column expression."""
    return df.withColumn(out, model.prediction())


def predict_ols_by_fold(df: DataFrame, models: dict, fold_col: str = "fold",
                        out: str = "prediction") -> DataFrame:
    """Out-of-fold predictions: each row scored by the model that did not see it."""
    expr = None
    for f, m in models.items():
        expr = (F.when(F.col(fold_col) == F.lit(f), m.prediction()) if expr is None
                else expr.when(F.col(fold_col) == F.lit(f), m.prediction()))
    return df.withColumn(out, expr)


# ---------------------------------------------------------------- pyspark.ml models

@dataclass
class ModelSpec:
    """A named estimator factory bound to a feature set."""
    name: str
    kind: str                      # "ols" | "forest" | "boosted"
    features: tuple
    params: dict = field(default_factory=dict)
    engine: str = "trees"          # of ensembles: "trees" (see trees.py) | "ml" (pyspark.ml, its own parameter names)
    local_rows: int = trees.LOCAL_ROWS


def forest(params=None, seed: int = 42) -> RandomForestRegressor:
    """A ``pyspark.ml`` forest of 300 trees, every feature considered at every split, depth 30 (its deepest)."""
    p = {"numTrees": 300, "featureSubsetStrategy": "all", "maxDepth": 30, "seed": seed,
         "maxBins": 64, "subsamplingRate": 1.0, "bootstrap": True}
    p.update(params or {})
    return RandomForestRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", **p)


def boosted(params=None, seed: int = 42) -> GBTRegressor:
    """``pyspark.ml`` boosting: 300 rounds, depth 6, rate 0.3 (leaf penalties have no counterpart there)."""
    p = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.3, "seed": seed, "maxBins": 64}
    p.update(params or {})
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", **p)


@dataclass
class FittedModel:
    spec: ModelSpec
    model: object                  # OLSModel, trees.Ensemble or a pyspark.ml model

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if isinstance(self.model, OLSModel):
            return predict_ols(df, self.model, out)
        if isinstance(self.model, trees.Ensemble):
            return trees.predict(df, self.model, out)
        a = assemble(df, list(self.spec.features))
        return self.model.transform(a).drop("features").withColumnRenamed("prediction", out) \
            if out != "prediction" else self.model.transform(a).drop("features")


def fit(spec: ModelSpec, df: DataFrame, target: str) -> FittedModel:
    """Fit one spec on a (cached) training frame."""
    if spec.kind == "ols":
        return FittedModel(spec, fit_ols(df, spec.features, target))
    if spec.engine == "trees":
        return FittedModel(spec, trees.fit_ensemble(df, spec.features, target, spec.kind, spec.params,
                                                    local_rows=spec.local_rows))
    est = forest(spec.params) if spec.kind == "forest" else boosted(spec.params)
    data = assemble(df, list(spec.features)).withColumn("label", qcol(target).cast("double"))
    return FittedModel(spec, est.fit(data.select("features", "label")))


# ---------------------------------------------------------------- random search

# Search spaces (lists of candidate values per parameter), for each of the two analyses.
BOOSTED_SPACE = {
    "n_estimators": [100, 200, 300, 400, 500],
    "max_depth": [2, 3, 4, 5, 6, 8],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 7],
    "reg_alpha": [0, 0.01, 0.1, 1],
    "reg_lambda": [0.5, 1, 1.5, 2],
}
BOOSTED_SPACE_TWO_YEARS = {
    "n_estimators": [50, 100, 150, 200, 300],
    "max_depth": [2, 3, 4, 5, 6],
    "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 7],
    "reg_alpha": [0, 0.01, 0.1, 1],
    "reg_lambda": [1, 1.5, 2, 3],
}
FOREST_SPACE = {
    "n_estimators": [100, 200, 300, 400, 500],
    "max_depth": [None, 3, 5, 8, 12, 16],
    "min_samples_split": [2, 4, 6, 10],
    "min_samples_leaf": [1, 2, 4, 6],
    "max_features": ["sqrt", "log2", 0.5, 1.0],
}
FOREST_SPACE_TWO_YEARS = {
    "n_estimators": [100, 200, 300, 400, 500],
    "max_depth": [3, 5, 7, 10, 15, None],
    "min_samples_split": [2, 5, 10, 15],
    "min_samples_leaf": [1, 2, 4, 8],
    "max_features": ["sqrt", "log2", 0.5, 0.7, 1.0],
}
N_DRAWS = 60     # draws of a search


def draw_params(space: dict, n_draws: int, seed: int = 42) -> list[dict]:
    """Distinct random draws from the grid (without replacement), seeded, on the driver."""
    keys = list(space)
    total = 1
    for k in keys:
        total *= len(space[k])
    rng = random.Random(seed)
    picks = rng.sample(range(total), min(n_draws, total))
    out = []
    for idx in picks:
        d = {}
        for k in keys:
            idx, r = divmod(idx, len(space[k]))
            d[k] = space[k][r]
        out.append(d)
    return out


def random_search(df: DataFrame, kind: str, features, target: str, space: dict, n_draws: int = N_DRAWS,
                  fold_col: str = "fold", seed: int = 42) -> tuple[DataFrame, dict]:
    """Seeded draws, mean and std of the folds' R² for each, and the best one."""
    return trees.search(df, kind, features, target, draw_params(space, n_draws, seed), fold_col, seed)
