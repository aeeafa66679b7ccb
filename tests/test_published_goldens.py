"""Published numbers of the original daily analysis, recomputed from its shipped
daily tables (2015 train, 2016 holdout).

Random folds and permutations of the original come from numpy's generators; they
are supplied as assignment tables (the operators' default is a salted hash).
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import anomaly as N
from diurna.operators import audit, encode
from diurna.operators import evaluate as E
from diurna.operators import importance as I
from diurna.operators import models as M
from diurna.operators import split as S

# Feature lists of the published models.
LINEAR = ["month", "day", "weekday_ord", "season", "is_holiday", "is_weekend", "weather_code", "t1", "hum",
          "wind_speed"]
ONEHOT_CATS = ["season", "weather_code", "weekday"]
ONEHOT_NUMS = ["month", "day", "is_holiday", "is_weekend", "t1", "hum", "wind_speed"]


def _prep(df):
    return encode.ordinal_weekday(df)


def _fold_table(spark, n=362, k=5, seed=42):
    idx = np.arange(n)
    np.random.RandomState(seed).shuffle(idx)
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    rows, start = [], 0
    for f, s in enumerate(sizes):
        rows += [(int(i) + 1, f) for i in idx[start:start + s]]   # instant = position + 1
        start += s
    return spark.createDataFrame(rows, "instant int, fold int")


def _onehot(train, test):
    lv = encode.union_levels([train, test], ONEHOT_CATS)
    tr, names = encode.one_hot(train, ONEHOT_CATS, level_map=lv, keep_source=True)
    te, _ = encode.one_hot(test, ONEHOT_CATS, level_map=lv, keep_source=True)
    return tr, te, ONEHOT_NUMS + names


def test_vif(daily_tables):
    tr, _ = daily_tables
    v = {r["feature"]: r["VIF"] for r in audit.vif(tr, ["t1", "t2", "hum", "wind_speed", "month", "day"]).collect()}
    for f, want in {"t1": 88.346, "t2": 91.343, "hum": 1.489, "wind_speed": 1.180, "month": 1.810,
                    "day": 1.005}.items():
        assert v[f] == pytest.approx(want, abs=0.002)


def test_working_identity_and_weekend_dependency(daily_tables):
    tr, te = daily_tables
    from diurna.functions.scalar import working_flag
    r = audit.dependency_check(tr, "working", working_flag("is_holiday", "is_weekend")).first()
    assert r["n_rows"] == 362 and r["holds"]
    both = tr.unionByName(te)
    wk = F.when(F.col("weekday").isin("Saturday", "Sunday"), 1.0).otherwise(0.0)
    assert audit.dependency_check(both, "is_weekend", wk).first()["n_violations"] == 0


def test_holdout_onehot_and_ordinal(daily_tables):
    tr, te = (_prep(d) for d in daily_tables)
    tr1, te1, feats = _onehot(tr, te)
    assert len(feats) == 21
    _, met = E.holdout(tr1, te1, M.ModelSpec("onehot", "ols", tuple(feats)), "cnt")
    t = met.where("split = 'test'").first()
    assert t["R2"] == pytest.approx(0.7690425889211305, abs=1e-9)
    assert t["RMSE"] == pytest.approx(4188.992708535846, abs=1e-5)
    assert t["MAE"] == pytest.approx(3119.628090333949, abs=1e-5)
    _, met = E.holdout(tr, te, M.ModelSpec("ordinal", "ols", tuple(LINEAR)), "cnt")
    assert met.where("split = 'test'").first()["R2"] == pytest.approx(0.7542115291565363, abs=1e-9)


def test_cv_goldens(spark, daily_tables):
    tr, te = (_prep(d) for d in daily_tables)
    folds = _fold_table(spark)
    trf = S.with_assignment(tr, folds, "instant")
    tr1, _, feats = _onehot(trf, te)
    s = E.fold_summary(E.cross_validate(tr1, M.ModelSpec("onehot", "ols", tuple(feats)), "cnt")).first()
    assert s["CV_R2_mean"] == pytest.approx(0.7617889910, abs=1e-9)
    assert s["CV_R2_std"] == pytest.approx(0.0164099786, abs=1e-9)
    assert s["CV_RMSE_mean"] == pytest.approx(4016.4827727, abs=1e-4)
    assert s["CV_MAE_mean"] == pytest.approx(2898.1430411, abs=1e-4)
    spec = M.ModelSpec("ordinal", "ols", tuple(LINEAR))
    s = E.fold_summary(E.cross_validate(trf, spec, "cnt")).first()
    assert s["CV_R2_mean"] == pytest.approx(0.7462172715, abs=1e-9)
    assert s["CV_R2_std"] == pytest.approx(0.0176214733, abs=1e-9)
    g = E.fold_gap(trf, spec, "cnt").agg(F.avg("train_R2"), F.avg("val_R2")).first()
    assert g[0] == pytest.approx(0.7731994391493243, abs=1e-9)
    assert g[1] == pytest.approx(0.7462172715400566, abs=1e-9)


def test_grouped_permutation_importance(spark, daily_tables):
    tr, te = (_prep(d) for d in daily_tables)
    tr1, te1, feats = _onehot(tr, te)
    fm = M.fit(M.ModelSpec("onehot", "ols", tuple(feats)), tr1, "cnt")
    groups = {c: [c] for c in ONEHOT_NUMS}
    for cat in ONEHOT_CATS:
        groups[cat] = [f for f in feats if f.startswith(f"{cat}_")]
    rng = np.random.default_rng(42)
    n = 365
    rows = []
    for var in groups:
        for rep in range(30):
            perm = rng.permutation(n)
            rows += [(var, rep, 363 + i, 363 + int(p)) for i, p in enumerate(perm)]
    assignment = spark.createDataFrame(rows, "variable string, repeat int, instant int, donor_key int")
    imp = {r["variable"]: r for r in I.permutation_importance(te1, fm, "cnt", groups, "instant",
                                                              assignment=assignment).collect()}
    assert imp["t1"]["importance_mean"] == pytest.approx(0.517149869901689, abs=1e-9)
    assert imp["t1"]["importance_std"] == pytest.approx(0.03563373160720519, abs=1e-9)
    assert imp["weekday"]["importance_mean"] == pytest.approx(0.04047232703790189, abs=1e-9)
    assert imp["weather_code"]["n_cols"] == 5 and imp["weekday"]["n_cols"] == 6
    assert imp["month"]["importance_mean"] == pytest.approx(-0.003619505834325117, abs=1e-9)


def test_isolation_forest_band(daily_tables):
    tr, _ = daily_tables
    feats = ["t1", "t2", "hum", "wind_speed", "weather_code", "cnt"]
    d = tr.withColumn("date", F.make_date("year", "month", "day"))
    out, model = N.detect(d, feats, "instant", n_trees=100, contamination=0.05, seed=42)
    flagged = out.where("is_outlier")
    assert flagged.count() == 19
    # The published 2015 anomaly dates.
    published = {"2015-07-01", "2015-07-09", "2015-01-04", "2015-03-31", "2015-02-22", "2015-01-31",
                 "2015-01-18", "2015-02-02", "2015-02-01", "2015-03-29", "2015-11-21", "2015-08-06",
                 "2015-08-22", "2015-11-01", "2015-02-03", "2015-06-30", "2015-01-20", "2015-02-06",
                 "2015-07-10"}
    ours = [str(r["date"]) for r in flagged.orderBy("anomaly_score").collect()]
    assert len(set(ours) & published) >= 12
    assert {"2015-07-01", "2015-07-09"} <= set(ours[:10])
    causes = N.attribute_causes(out, model, "instant")
    assert causes.count() == 19 and set(r["cause"] for r in causes.collect()) <= set(feats)


def test_final_comparison_table(spark, daily_tables):
    """Entry 2 end to end: the two OLS rows of the published final comparison."""
    from diurna.plans.analysis import final_comparison
    tr, te = (_prep(d) for d in daily_tables)
    trf = S.with_assignment(tr, _fold_table(spark), "instant")
    tr1, te1, feats = _onehot(trf, te)
    specs = [M.ModelSpec("LinearRegression_onehot", "ols", tuple(feats)),
             M.ModelSpec("LinearRegression_ordinal", "ols", tuple(LINEAR))]
    t = {r["model"]: r for r in final_comparison(tr1, te1, specs, "cnt").collect()}
    oh, od = t["LinearRegression_onehot"], t["LinearRegression_ordinal"]
    assert oh["rank"] == 1 and od["rank"] == 2
    assert oh["CV_R2_mean"] == pytest.approx(0.7617889910149874, abs=1e-9)
    assert oh["CV_R2_std"] == pytest.approx(0.016409978615003817, abs=1e-9)
    assert oh["holdout_R2"] == pytest.approx(0.7690425889211305, abs=1e-9)
    assert od["holdout_RMSE"] == pytest.approx(4321.3993961547685, abs=1e-5)
    assert od["holdout_MAE"] == pytest.approx(3295.1639741868953, abs=1e-5)


def test_worst_error_and_anomaly_overlap_2016(spark, daily_tables):
    """Entry 3: the largest 2016 error is Christmas day (published 24,245)."""
    from diurna.plans.analysis import error_anomaly_overlap
    tr, te = (_prep(d) for d in daily_tables)
    tr1, te1, feats = _onehot(tr, te)
    fm = M.fit(M.ModelSpec("onehot", "ols", tuple(feats)), tr1, "cnt")
    te2 = te1.withColumn("date", F.make_date("year", "month", "day").cast("string"))
    scored, _ = N.detect(te2, ["t1", "t2", "hum", "wind_speed", "weather_code", "cnt"], "date", n_trees=100)
    w = error_anomaly_overlap(fm, te2, scored, "date", "cnt").orderBy("rank").collect()
    assert w[0]["date"] == "2016-12-25" and w[0]["abs_error"] == pytest.approx(24245.43033396462, abs=1e-6)
    assert len(w) == 10 and scored.where("is_outlier").count() == 19


def test_tree_bands(daily_tables):
    """Default forest and boosted trees near the published holdout R² (0.739, 0.691), whatever the seed."""
    tr, te = daily_tables
    feats = ("month", "day", "weekday_ord", "season", "is_holiday", "is_weekend", "weather_code", "t1", "t2", "hum",
             "wind_speed")
    both = tr.withColumn("fold", F.lit(0)).unionByName(te.withColumn("fold", F.lit(1)))
    from diurna.operators import trees
    oof = trees.out_of_fold(_prep(both), feats, "cnt", [("forest", {}, 1), ("boosted", {}, 1)])
    r2 = {r["job"]: r["R2"] for r in E.regression_metrics(oof, "label", "prediction", keys=("job",)).collect()}
    assert r2[0] == pytest.approx(0.739, abs=0.03) and r2[1] == pytest.approx(0.691, abs=0.03)
