"""Rows-only operators checked against brute force on small fixtures."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import anomaly as N
from diurna.operators import evaluate as E
from diurna.operators import importance as I
from diurna.operators import models as M


def _naive_path(model, x):
    feat, thr, leaf_len = model.arrays()
    out = []
    for row in x:
        tot = 0
        for t in range(feat.shape[0]):
            node = 1
            while feat[t, node] >= 0:
                node = 2 * node + (row[feat[t, node]] >= thr[t, node])
            tot += int(leaf_len[t, node])
        out.append(tot / feat.shape[0] / 1e9)
    return np.array(out)


def test_forest_scores_match_naive_traversal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    x[:5] += 6.0                                     # five obvious outliers
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    scored, model = N.detect(df, ["a", "b", "c"], "k", n_trees=20, contamination=0.05, seed=7)
    got = {r["k"]: r["anomaly_score"] for r in scored.collect()}
    from diurna.operators.anomaly import avg_path_length
    e = _naive_path(model, x)
    want = -np.power(2.0, -e / avg_path_length([model.sample_size])[0]) - model.offset
    assert max(abs(got[i] - want[i]) for i in range(500)) < 1e-12
    flagged = {r["k"] for r in scored.where("is_outlier").collect()}
    assert len(flagged) == 25 and set(range(5)) <= flagged
    # every tree saw exactly min(256, n) rows
    assert model.nodes.groupby("tree")["size"].max().eq(256).all()


class _Opaque:
    """Wraps a fitted OLS so importance takes the general (row-shuffling) path."""
    def __init__(self, ols):
        self.ols = ols


def test_permutation_fast_path_equals_general_path(spark):
    rng = np.random.default_rng(2)
    n = 400
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 3, size=n)
    y = 3 * a - 2 * b + c + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(c[i] == 1), float(c[i] == 2), float(y[i]))
                                for i in range(n)], "k long, a double, b double, c_1 double, c_2 double, y double")
    spec = M.ModelSpec("ols", "ols", ("a", "b", "c_1", "c_2"))
    fm = M.fit(spec, df, "y")
    groups = {"a": ["a"], "b": ["b"], "c": ["c_1", "c_2"]}
    fast = {r["variable"]: r for r in I.permutation_importance(df, fm, "y", groups, "k", n_repeats=4).collect()}

    class General(M.FittedModel):
        def transform(self, d, out="prediction"):
            return M.predict_ols(d, self.model.ols, out)
    general = General(spec, _Opaque(fm.model))
    slow = {r["variable"]: r for r in I.permutation_importance(df, general, "y", groups, "k", n_repeats=4).collect()}
    for v in groups:
        assert fast[v]["importance_mean"] == pytest.approx(slow[v]["importance_mean"], abs=1e-12)
        assert fast[v]["importance_std"] == pytest.approx(slow[v]["importance_std"], abs=1e-12)
    assert fast["a"]["importance_mean"] > fast["c"]["importance_mean"] > 0


def test_permutation_is_a_permutation(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(300)], "k long, x double, y double")
    fm = M.fit(M.ModelSpec("ols", "ols", ("x",)), df, "y")
    sc = I.permuted_scores(df, fm, "y", {"x": ["x"]}, "k", n_repeats=3)
    # each stratum keeps every row once and the shuffled predictions are a rearrangement
    per = sc.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("s")).collect()
    base = sum(float(i) for i in range(300))
    assert all(r["n"] == 300 and r["s"] == pytest.approx(base) for r in per)


def _naive(x, y, w, rows, depth, child=1, lam=0.0, alpha=0.0):
    """Leaf value of every row by exhaustive search over all cuts."""
    s = lambda r: np.sign(t := (y[r] * w[r]).sum()) * max(abs(t) - alpha, 0.0)
    H = lambda r: w[r].sum()
    best, own = None, s(rows) ** 2 / (H(rows) + lam)
    for f in range(x.shape[1]):
        for cut in np.unique(x[rows, f])[:-1]:
            low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
            if min(H(low), H(high)) < child:
                continue
            score = s(low) ** 2 / (H(low) + lam) + s(high) ** 2 / (H(high) + lam)
            if best is None or score > best[0] + 1e-9:
                best = (score, f, cut)
    if depth == 0 or best is None or best[0] <= own + 1e-9:
        return {int(r): s(rows) / (H(rows) + lam) for r in rows}
    low = x[rows, best[1]] <= best[2]
    return _naive(x, y, w, rows[low], depth - 1, child, lam, alpha) | _naive(x, y, w, rows[~low], depth - 1, child, lam, alpha)


@pytest.mark.parametrize("params", [{"max_depth": 3, "reg_lambda": 0}, {"max_depth": 2, "min_child_weight": 9},
                                    {"max_depth": 4, "reg_alpha": 700, "reg_lambda": 2.5}])
def test_grown_trees_equal_a_naive_search(params):
    from diurna.operators import trees as T
    rng = np.random.default_rng(0)
    codes, y = rng.integers(0, 9, (60, 3)).astype(np.uint8), rng.integers(-1000, 1000, 60)
    w = np.ones(60, np.int64)
    fit = T.Fit("boosted", {"learning_rate": 1.0, **params})
    t = T.grow(codes, y, w, fit, 0, 1.0)
    walk = T.Walk([t])
    got = T._leaf_values(fit, 1.0, walk.total, walk.weight)[walk.ends(codes)[:, 0]]
    want = _naive(codes.astype(int), y, w, np.arange(60), params["max_depth"], fit.child, *fit.penalties(1.0))
    assert np.allclose(got, [want[i] for i in range(60)], atol=0.51)       # boosting's leaves are whole units


def _regression(spark, n=300, folds=4):
    rng = np.random.default_rng(3)
    rows = [(i, i % folds, float(np.round(a, 1)), float(b), float(c), float(3 * a - b * b + rng.normal() * .2))
            for i, (a, b, c) in enumerate(rng.normal(size=(n, 3)))]
    return spark.createDataFrame(rows, "k long, fold int, a double, b double, c double, y double")


def _shape(model):
    """Trees as nested splits, whatever their nodes' numbers."""
    def rec(t, i):
        if t.feature[i] < 0:
            return int(t.weight[i]), int(t.total[i])
        return int(t.feature[i]), int(t.bin[i]), float(t.gain[i]), rec(t, t.left[i]), rec(t, t.right[i])
    return model.base, [rec(t, 0) for t in model.trees]


def test_trees_are_the_same_grown_on_spark_or_in_tasks(spark):
    """Levels by Spark sums, subtrees in tasks, whole fits in tasks, other partitions: the same models."""
    from diurna.operators import trees as T
    df = _regression(spark)
    fits = [T.Fit("forest", {"n_estimators": 3, "max_features": 0.7}, (0,)),
            T.Fit("forest", {"n_estimators": 2, "max_depth": 4, "min_samples_leaf": 3, "min_samples_split": 8}),
            T.Fit("boosted", {"n_estimators": 2, "max_depth": 3, "reg_alpha": 0.5, "subsample": 0.8, "colsample_bytree": 0.7}, (1,))]
    want = [_shape(m) for m in T.fit_all(T.binned(df, ["a", "b", "c"], "y", "fold"), fits)]
    for local_rows, parts in ((0, 2), (40, 5)):
        data = T.binned(df.repartition(parts), ["a", "b", "c"], "y", "fold")
        assert [_shape(m) for m in T.fit_all(data, fits, local_rows)] == want


def test_out_of_fold_either_way_and_saved_models(spark):
    from diurna.operators import trees as T
    df = _regression(spark)
    jobs = [("forest", {"n_estimators": 4}, 1), ("boosted", {"n_estimators": 3, "max_depth": 2}, 0, 3)]
    rows = []
    for local_rows in (T.LOCAL_ROWS, 60):
        out = T.out_of_fold(df, ["a", "b", "c"], "y", jobs, roles=True, local_rows=local_rows).collect()
        rows.append(sorted((r.job, r.fold, r.role, round(r.label, 6), round(r.prediction, 6)) for r in out))
    assert rows[0] == rows[1] and len(rows[0]) == 300 + 225
    m = T.fit_ensemble(df, ["a", "b", "c"], "y", "forest", {"n_estimators": 5})
    again = T.Ensemble.from_json(m.to_json())
    x = [[r.a, r.b, r.c] for r in df.select("a", "b", "c").collect()]
    assert np.array_equal(m.predict(np.array(x)), again.predict(np.array(x)))
    # few distinct values are cut half-way, and a row is scored as its bins say
    assert len(m.cuts[0]) + 1 == df.select("a").distinct().count()
    with pytest.raises(ValueError):
        T.binned(df.withColumn("a", F.when(F.col("k") > 0, F.col("a"))), ["a"], "y")


def test_bootstrap_weights_are_poisson():
    from diurna.operators import trees as T
    h = np.arange(20000, dtype=np.uint64)
    w = T.Fit("forest").weights(h, np.zeros(20000, int), 3)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w, T.Fit("forest").weights(h, np.zeros(20000, int), 4))[0, 1]) < 0.03


def test_search_shares_trees_between_draws(spark):
    """Every draw of a forest search scores as if its forest had been grown alone."""
    from diurna.operators import trees as T
    df = _regression(spark, 160)
    draws = [{"n_estimators": 30, "max_depth": d, "min_samples_split": s, "min_samples_leaf": leaf, "max_features": f}
             for d, s, leaf, f in ((None, 2, 1, 1.0), (3, 6, 1, 1.0), (5, 2, 4, 0.5))] + [
        {"n_estimators": 7, "max_depth": None, "min_samples_split": 10, "min_samples_leaf": 1, "max_features": 1.0}]
    table, best = T.search(df, "forest", ["a", "b", "c"], "y", draws)
    got = {r.draw: r.cv_R2_mean for r in table.collect()}
    for i, d in enumerate(draws):
        oof = T.out_of_fold(df, ["a", "b", "c"], "y", [("forest", d, f) for f in range(4)])
        alone = E.regression_metrics(oof, "label", "prediction", keys=("fold",)).agg(F.avg("R2")).first()[0]
        assert got[i] == pytest.approx(alone, abs=1e-9)
    assert best == draws[max(got, key=got.get)]


def test_gain_importance_is_the_split_table_summed(spark):
    from diurna.operators import trees as T
    df = _regression(spark)
    for kind, params in (("forest", {"n_estimators": 4}), ("boosted", {"n_estimators": 4, "max_depth": 2})):
        fm = M.fit(M.ModelSpec(kind, kind, ("a", "b", "c"), params), df, "y")
        nodes = fm.model.node_rows()
        used = nodes[nodes.feature.notna()]
        if kind == "boosted":
            part = used.groupby("feature").gain.mean()
        else:
            part = sum((t.groupby("feature").gain.sum() / t.gain.sum()).reindex(list("abc"), fill_value=0)
                       for _, t in used.groupby("tree"))
        got = {r.feature: r.gain_importance for r in I.impurity_importance(fm).collect()}
        assert set(got) == set("abc") and sum(got.values()) == pytest.approx(1)
        assert all(got[f] == pytest.approx(part.get(f, 0) / part.sum()) for f in got)
        # weights of children add up to their parent's
        for _, t in nodes.groupby("tree"):
            w = t.set_index("node").weight
            inner = t[t.left >= 0]
            assert (w.loc[inner.left].to_numpy() + w.loc[inner.right].to_numpy() == inner.weight.to_numpy()).all()


def test_stored_comparison_resumes(spark):
    """A second run reads the stored rows; a further model fits alone; other data are other tables."""
    from diurna.operators import trees as T
    from diurna.plans import analysis
    store = f"fitted-{uuid.uuid4().hex}"       # the folder may outlive a session
    comparison = lambda *a: analysis.comparison(*a, store=store)
    df = _regression(spark, 200)
    train, test = df.where("k < 150"), df.where("k >= 150")
    specs = [M.ModelSpec("o", "ols", ("a", "b")), M.ModelSpec("f", "forest", ("a", "b", "c"), {"n_estimators": 4})]
    first = sorted(map(tuple, comparison(train, test, specs, "y").collect()))
    calls, before = [], T.out_of_fold
    T.out_of_fold = lambda *a, **k: calls.append(a) or before(*a, **k)
    try:
        assert sorted(map(tuple, comparison(train, test, specs, "y").collect())) == first and not calls
        more = [*specs, M.ModelSpec("b", "boosted", ("a", "b", "c"), {"n_estimators": 3})]
        assert comparison(train, test, more, "y").count() == 3 and len(calls) == 1
        assert {j[0] for j in calls[0][3]} == {"boosted"}
        assert analysis.fitted_metrics(train.where("k > 3"), test, specs, "y", store=store).count() == 2 * (4 + 2) and len(calls) == 2
    finally:
        T.out_of_fold = before
    r = {x.model: x for x in comparison(train, test, specs, "y").collect()}
    assert all(v.CV_R2_mean is not None and v.overfit_gap == pytest.approx(v.train_R2 - v.holdout_R2) for v in r.values())


def test_null_labels_are_an_error(spark):
    df = spark.range(100).selectExpr("id AS k", "CAST(id AS double) AS x", "IF(id % 3 = 0, NULL, 2D * id + 1) AS y",
                                     "CAST(id % 5 AS int) AS fold", "0D AS prediction")
    with pytest.raises(ValueError):
        M.fit_ols(df, ["x"], "y")
    with pytest.raises(ValueError):
        M.fit_ols_folds(df, ["x"], "y")
    with pytest.raises(Exception, match="NULL or NaN"):
        E.regression_metrics(df, "y").collect()
    full = df.where("y IS NOT NULL")
    m = M.fit_ols(full, ["x"], "y")
    assert m.coef[0] == pytest.approx(2) and m.intercept == pytest.approx(1)
    assert E.regression_metrics(full, "y").first()["n"] == 66


def test_fold_gap_from_moments_equals_scoring(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(int(i % 5), float(a), float(a * 2 + e)) for i, (a, e) in enumerate(rng.normal(size=(200, 2)))],
                               "fold int, x double, y double")
    spec = M.ModelSpec("o", "ols", ("x",))
    got = {r["fold"]: r for r in E.fold_gap(df, spec, "y").collect()}
    val = {r["fold"]: r["R2"] for r in E.cross_validate(df, spec, "y").collect()}
    for f, m in M.fit_ols_folds(df, ["x"], "y").items():
        tr = E.regression_metrics(M.predict_ols(df.where(F.col("fold") != f), m), "y").first()["R2"]
        assert got[f]["train_R2"] == pytest.approx(tr) and got[f]["val_R2"] == pytest.approx(val[f])
