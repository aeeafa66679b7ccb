"""Evaluation tables.

Metrics are SQL aggregates, computed in one pass per table and per group
(model, split, fold): R² = 1 - SSE / SST, RMSE = sqrt(mean e²), MAE = mean |e|.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import models as M


def regression_metrics(df: DataFrame, label: str, pred: str = "prediction", keys=()) -> DataFrame:
    """M9: n, R², RMSE, MAE per group (one aggregate). A NULL or NaN label or prediction is an
    error when the table is computed: a metric over the other rows would look like one over all."""
    y = F.col(label).cast("double")
    p = F.col(pred).cast("double")
    e = y - p
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("__n"), F.sum(e * e).alias("__sse"),
                (F.var_pop(y) * F.count(F.lit(1))).alias("__sst"), F.avg(F.abs(e)).alias("__mae"),
                F.count_if(y.isNull() | F.isnan(y) | p.isNull() | F.isnan(p)).alias("__missing"))

    def checked(value, kind):
        stop = F.raise_error(F.lit("NULL or NaN label or prediction")).cast(kind)
        return F.when(F.col("__missing") > 0, stop).otherwise(value)
    return out.select(
        *keys, checked(F.col("__n"), "long").alias("n"),
        checked(F.lit(1.0) - F.col("__sse") / F.col("__sst"), "double").alias("R2"),
        checked(F.sqrt(F.col("__sse") / F.col("__n")), "double").alias("RMSE"),
        checked(F.col("__mae"), "double").alias("MAE"))


def fold_summary(per_fold: DataFrame, keys=(), metrics=("R2", "RMSE", "MAE")) -> DataFrame:
    """Mean and population std (ddof 0) of fold metrics."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"CV_{m}_mean"), F.stddev_pop(m).alias(f"CV_{m}_std")]
    return (per_fold.groupBy(*keys) if keys else per_fold.groupBy()).agg(*aggs)


def cross_validate(df: DataFrame, spec: M.ModelSpec, target: str, fold_col: str = "fold") -> DataFrame:
    """Per-fold validation metrics from out-of-fold predictions (one fit per fold,
    all three metrics from the same predictions)."""
    if spec.kind == "ols":
        models = M.fit_ols_folds(df, spec.features, target, fold_col)
        pred = M.predict_ols_by_fold(df, models, fold_col)
        return regression_metrics(pred, target, "prediction", keys=(fold_col,))
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    if spec.engine == "trees":
        from . import trees
        oof = trees.out_of_fold(df, spec.features, target, [(spec.kind, spec.params, f) for f in folds], fold_col,
                                local_rows=spec.local_rows)
        return regression_metrics(oof, "label", "prediction", keys=("fold",)).withColumnRenamed("fold", fold_col)
    parts = []
    for f in folds:
        fm = M.fit(spec, df.where(F.col(fold_col) != f), target)
        parts.append(fm.transform(df.where(F.col(fold_col) == f)))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    return regression_metrics(pred, target, "prediction", keys=(fold_col,))


def fold_gap(df: DataFrame, spec: M.ModelSpec, target: str, fold_col: str = "fold") -> DataFrame:
    """Per fold, R² on the training folds vs on the held-out fold.

    For OLS everything follows from the folds' moments, collected in one aggregate: the
    fits, and the squared errors on both sides; no row is scored.
    """
    if spec.kind == "ols":
        per = M.fold_moments(df, spec.features, target, fold_col)
        kind = df.schema[fold_col].dataType.simpleString()
        rows = []
        for f, m in M.ols_by_fold(per, list(spec.features)).items():
            t, v = M.moments_r2(M.others_moments(per, f), m), M.moments_r2(per[f], m)
            rows.append((f, t, v, t - v))
        return df.sparkSession.createDataFrame(
            rows, f"`{fold_col}` {kind}, train_R2 double, val_R2 double, gap double")
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    if spec.engine == "trees":
        from . import trees
        scored = trees.out_of_fold(df, spec.features, target, [(spec.kind, spec.params, f) for f in folds], fold_col,
                                   roles=True, local_rows=spec.local_rows)
        met = regression_metrics(scored.withColumnRenamed("fold", "__k"), "label", "prediction", keys=("__k", "role"))
    else:
        rows = []
        for f in folds:
            fm = M.fit(spec, df.where(F.col(fold_col) != f), target)
            rows.append(fm.transform(df).withColumn("__k", F.lit(f)))
        scored = rows[0]
        for r in rows[1:]:
            scored = scored.unionByName(r)
        scored = scored.withColumn("role", F.when(F.col(fold_col) == F.col("__k"), "validation").otherwise("train"))
        met = regression_metrics(scored, target, "prediction", keys=("__k", "role"))
    return met.groupBy(F.col("__k").alias(fold_col)).agg(
        F.max(F.when(F.col("role") == "train", F.col("R2"))).alias("train_R2"),
        F.max(F.when(F.col("role") == "validation", F.col("R2"))).alias("val_R2")) \
        .withColumn("gap", F.col("train_R2") - F.col("val_R2"))


def holdout(df_train: DataFrame, df_test: DataFrame, spec: M.ModelSpec, target: str):
    """Refit on all training rows, score train and test once.

    Returns (fitted model, metrics with a ``split`` column)."""
    fm = M.fit(spec, df_train, target)
    both = fm.transform(df_train.withColumn("split", F.lit("train"))).unionByName(
        fm.transform(df_test.withColumn("split", F.lit("test"))), allowMissingColumns=True)
    return fm, regression_metrics(both, target, "prediction", keys=("split",))


def holdout_tagged(df: DataFrame, spec: M.ModelSpec, target: str, split_col: str = "split",
                   train: str = "train"):
    """M18/M13 on a frame that carries its split tag: fit on the training rows,
    then one scan scores every row and aggregates metrics per split."""
    fm = M.fit(spec, df.where(F.col(split_col) == train), target)
    return fm, regression_metrics(fm.transform(df), target, "prediction", keys=(split_col,))


def comparison_row(spec: M.ModelSpec, cv: DataFrame | None, hold: DataFrame) -> DataFrame:
    """CV mean/std beside holdout metrics and the over-fit gap, one row per model.

    ``cv`` holds per-fold metrics (M12) or is None when no CV was run."""
    if cv is None:
        spark = hold.sparkSession
        cols = [f"CV_{m}_{s}" for m in ("R2", "RMSE", "MAE") for s in ("mean", "std")]
        s = spark.createDataFrame([tuple([None] * len(cols))], ", ".join(f"{c} double" for c in cols))
    else:
        s = fold_summary(cv)
    h = hold.groupBy().agg(
        *[F.max(F.when(F.col("split") == "test", F.col(m))).alias(f"holdout_{m}") for m in ("R2", "RMSE", "MAE")],
        F.max(F.when(F.col("split") == "train", F.col("R2"))).alias("train_R2"))
    return s.crossJoin(h).select(F.lit(spec.name).alias("model"), F.lit(len(spec.features)).alias("n_features"),
                                 "*").withColumn("overfit_gap", F.col("train_R2") - F.col("holdout_R2"))


def winners(table: DataFrame, metrics: dict, key: str = "model") -> DataFrame:
    """Best model per metric (direction per metric: 'max' or 'min'), ties by name."""
    rows = []
    for m, direction in metrics.items():
        order = F.col(m).desc() if direction == "max" else F.col(m).asc()
        w = Window.orderBy(order, F.col(key))
        rows.append(table.select(F.lit(m).alias("metric"), key, F.col(m).alias("value"),
                                 F.rank().over(w).alias("rank")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def overfit_table(spec_name: str, hold: DataFrame) -> DataFrame:
    """Train R² - test R² from a holdout metrics table."""
    return hold.groupBy().agg(
        F.max(F.when(F.col("split") == "train", F.col("R2"))).alias("train_R2"),
        F.max(F.when(F.col("split") == "test", F.col("R2"))).alias("test_R2")) \
        .select(F.lit(spec_name).alias("model"), "*").withColumn("overfit_gap", F.col("train_R2") - F.col("test_R2"))


def metric_record(spec: M.ModelSpec, target: str, metrics: DataFrame, n_train: int, n_test: int,
                  test_size: float, seed: int) -> DataFrame:
    """One-row record of a fit: model, target, features, sizes, seed and test metrics."""
    t = metrics.where(F.col("split") == "test").select("R2", "RMSE", "MAE")
    return t.select(F.lit(spec.name).alias("model"), F.lit(target).alias("target"),
                    F.lit(",".join(spec.features)).alias("features"), F.lit(float(test_size)).alias("test_size"),
                    F.lit(int(seed)).alias("random_state"), F.lit(int(n_train)).cast("long").alias("n_train"),
                    F.lit(int(n_test)).cast("long").alias("n_test"), "R2", "RMSE", "MAE")


def cv_holdout_agreement(table: DataFrame, cv_metric: str = "CV_R2_mean", holdout_metric: str = "holdout_R2",
                         key: str = "model") -> DataFrame:
    """Does the model that wins cross-validation also win the holdout?"""
    cv = table.agg(F.max_by(key, F.struct(F.col(cv_metric), F.col(key))).alias("cv_winner"))
    ho = table.agg(F.max_by(key, F.struct(F.col(holdout_metric), F.col(key))).alias("holdout_winner"))
    return cv.crossJoin(ho).withColumn("agree", F.col("cv_winner") == F.col("holdout_winner"))


def tuning_report(train: DataFrame, test: DataFrame, kind: str, features, target: str, best_params: dict,
                  default_params: dict | None = None, fold_col: str = "fold") -> DataFrame:
    """before/after tuning — default and tuned configurations, each refit on
    all training rows and scored once on the holdout, with CV R² and the over-fit gap."""
    import json
    rows = None
    for stage, params in (("default", default_params or {}), ("tuned", best_params)):
        spec = M.ModelSpec(f"{kind}_{stage}", kind, tuple(features), params)
        _, hold = holdout(train, test, spec, target)
        cv = fold_summary(cross_validate(train, spec, target, fold_col))
        h = hold.groupBy().agg(
            F.max(F.when(F.col("split") == "train", F.col("R2"))).alias("train_R2"),
            *[F.max(F.when(F.col("split") == "test", F.col(m))).alias(f"test_{m}") for m in ("R2", "RMSE", "MAE")])
        row = h.crossJoin(cv.select("CV_R2_mean", "CV_RMSE_mean", "CV_MAE_mean")).select(
            F.lit(stage).alias("stage"), "*", F.lit(json.dumps(best_params if stage == "tuned" else params,
                                                               sort_keys=True, default=str)).alias("best_params"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("overfit_gap", F.col("train_R2") - F.col("test_R2"))
