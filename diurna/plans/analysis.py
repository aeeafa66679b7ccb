"""End-to-end flows built from the operators (the lifecycles of the original work).

* :func:`final_comparison` — CV on the training part beside one refit scored on
  the holdout, for several model specs, ranked by holdout R² (entry 2).
* :func:`anomaly_report` — forest, threshold, causes and their distribution (entry 3).
* :func:`error_anomaly_overlap` — the worst holdout errors flagged by anomaly
  membership (entry 3, second half).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import anomaly as N
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import report as R
from ..operators import trees
from ..session import cut_lineage, finished, scratch_path


def final_comparison(train: DataFrame, test: DataFrame, specs, target: str, fold_col: str = "fold") -> DataFrame:
    """One row per model — CV mean/std on ``train`` folds, holdout R²/RMSE/MAE,
    train R² and over-fit gap — ranked by holdout R² (best first)."""
    rows = None
    for spec in specs:
        _, hold = E.holdout(train, test, spec, target)
        row = E.comparison_row(spec, E.cross_validate(train, spec, target, fold_col), hold)
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.col("holdout_R2").desc(), F.col("model"))))


METRICS = "model string, fold int, role string, n bigint, R2 double, RMSE double, MAE double"


def _frame_digest(df: DataFrame) -> str:
    """Digest of a frame's rows, whatever their order."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return hashlib.md5(repr([df.columns, *r]).encode()).hexdigest()


def fitted_metrics(train: DataFrame, test: DataFrame, specs, target: str, fold_col: str = "fold",
                   store: str = "fitted") -> DataFrame:
    """(model, fold, role, n, R2, RMSE, MAE) of every model fitted without each fold (role
    validation), and on the whole training part (fold null; roles train and test).

    The rows of a model are a table of their own in the shared checkpoint folder, named by the digest of
    the frames and of the model. A later run, also after a crash or of another application, fits
    only the models that have none. All missing tree fits are one job: the test part is one more fold,
    which the CV fits never see."""
    spark = train.sparkSession
    data = hashlib.md5((_frame_digest(train) + _frame_digest(test) + target + fold_col).encode()).hexdigest()
    at = lambda s: scratch_path(spark, f"{store}-{data}/" + hashlib.md5(
        json.dumps([s.name, s.kind, list(s.features), s.params, s.engine, trees.RULES], sort_keys=True).encode()).hexdigest())
    missing = [s for s in specs if not finished(spark, at(s))]
    for spec in (s for s in missing if s.kind == "ols"):
        _, hold = E.holdout(train, test, spec, target)
        cv = E.cross_validate(train, spec, target, fold_col)
        rows = cv.select(F.lit(spec.name).alias("model"), F.col(fold_col).cast("int").alias("fold"),
                         F.lit("validation").alias("role"), "n", "R2", "RMSE", "MAE").unionByName(hold.select(
                             F.lit(spec.name).alias("model"), F.lit(None).cast("int").alias("fold"),
                             F.col("split").alias("role"), "n", "R2", "RMSE", "MAE"))
        rows.write.mode("overwrite").parquet(at(spec))
    grown = [s for s in missing if s.kind != "ols"]
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect()) if grown else []
    held = -1 - max((abs(f) for f in folds), default=0)
    for feats in dict.fromkeys(s.features for s in grown):
        mine = [s for s in grown if s.features == feats]
        both = train.select(*feats, target, fold_col).unionByName(
            test.select(*feats, target, F.lit(held).cast("int").alias(fold_col)))
        jobs = [(s.kind, s.params, f, held) for s in mine for f in folds] + [(s.kind, s.params, held) for s in mine]
        scored = trees.out_of_fold(both, feats, target, jobs, fold_col, roles=True)
        # the CV fits' training rows are not asked for
        met = cut_lineage(E.regression_metrics(scored.where(
            (F.col("role") == "validation") | (F.col("job") >= len(mine) * len(folds))), "label", "prediction",
            keys=("job", "role")))
        for i, spec in enumerate(mine):
            job = F.col("job")
            whole = job == len(mine) * len(folds) + i
            cv = job.between(i * len(folds), (i + 1) * len(folds) - 1)
            fold = F.when(cv, F.element_at(F.array(*[F.lit(int(f)) for f in folds]), job - i * len(folds) + 1))
            role = F.when(whole & (F.col("role") == "validation"), "test").otherwise(F.col("role"))
            met.where(whole | cv).select(F.lit(spec.name).alias("model"), fold.cast("int").alias("fold"),
                                         role.alias("role"), "n", "R2", "RMSE", "MAE").write.mode("overwrite").parquet(at(spec))
    return spark.read.schema(METRICS).parquet(*[at(s) for s in specs])


def stored_search(train: DataFrame, kind: str, features, target: str, space: dict, n_draws: int = M.N_DRAWS,
                  fold_col: str = "fold", seed: int = 42) -> DataFrame:
    """The table of :func:`models.random_search`, kept as :func:`fitted_metrics` keeps its rows."""
    spark = train.sparkSession
    what = json.dumps([_frame_digest(train), kind, list(features), target, space, n_draws, fold_col, seed, trees.RULES], sort_keys=True)
    path = scratch_path(spark, f"searched-{hashlib.md5(what.encode()).hexdigest()}")
    if not finished(spark, path):
        M.random_search(train, kind, features, target, space, n_draws, fold_col, seed)[0].write.mode("overwrite").parquet(path)
    return spark.read.schema("draw int, params string, cv_R2_mean double, cv_R2_std double").parquet(path)


def comparison(train: DataFrame, test: DataFrame, specs, target: str, fold_col: str = "fold",
               store: str = "fitted") -> DataFrame:
    """As :func:`final_comparison`, over the stored table of fitted models."""
    met = fitted_metrics(train, test, specs, target, fold_col, store)
    cv = E.fold_summary(met.where("role = 'validation'"), keys=("model",))
    of = lambda role, m: F.max(F.when(F.col("role") == role, F.col(m)))
    hold = met.groupBy("model").agg(*[of("test", m).alias(f"holdout_{m}") for m in ("R2", "RMSE", "MAE")],
                                    of("train", "R2").alias("train_R2"))
    sizes = train.sparkSession.createDataFrame([(s.name, len(s.features)) for s in specs], "model string, n_features int")
    out = sizes.join(cv, "model").join(hold, "model").withColumn("overfit_gap", F.col("train_R2") - F.col("holdout_R2"))
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.col("holdout_R2").desc(), F.col("model"))))


def anomaly_report(df: DataFrame, features, key: str, n_trees: int = 100, contamination: float = 0.05,
                   seed: int = 42):
    """(scored rows, causes per anomaly, cause counts, fitted forest)."""
    scored, forest = N.detect(df, features, key, n_trees=n_trees, contamination=contamination, seed=seed)
    causes = N.attribute_causes(scored, forest, key)
    return scored, causes, N.cause_distribution(causes), forest


def error_anomaly_overlap(fitted: M.FittedModel, test: DataFrame, anomalies: DataFrame, key: str, target: str,
                          k: int = 10, round_prediction: bool = False) -> DataFrame:
    """M25 + J4/J5: the k worst holdout errors with an anomaly-membership flag."""
    worst = R.worst_predictions(fitted.transform(test), key, target, k=k, round_prediction=round_prediction)
    return R.flag_membership(worst, anomalies.where("is_outlier"), key, "is_isoforest_outlier")
