"""Registered model queries: OLS fit, holdout, CV, fold gap, worst errors, permutation
importance (oracle-exact), plus tree models, search and anomalies (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_int
from ..operators import evaluate as E
from ..operators import importance as I
from ..operators import models as M
from ..operators import report as R
from ..operators import split as S
from .frames import SQL_LINE_FRAME, line_frame
from .registry import register

OLS2 = M.ModelSpec("ols_quantity_discount", "ols", ("l_quantity", "l_discount"))
N_PERM = 30


def _frame(spark, base):
    return line_frame(spark, base)


# ------------------------------------------------------------------ SQL twins of a 2-regressor OLS
def _sql_moments(src, where="", group=""):
    return f"""SELECT {group + ',' if group else ''} avg(l_quantity) AS mx1, avg(l_discount) AS mx2, avg(revenue) AS my,
       covar_samp(l_quantity, l_quantity) AS s11, covar_samp(l_quantity, l_discount) AS s12,
       covar_samp(l_discount, l_discount) AS s22, covar_samp(l_quantity, revenue) AS s1y,
       covar_samp(l_discount, revenue) AS s2y FROM {src} {where} {'GROUP BY ' + group if group else ''}"""


def _sql_coef(m):
    return f"""SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
       (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2,
       my - mx1 * (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)
          - mx2 * (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS a FROM ({m})"""


SQL_BASE = f"""
WITH d AS ({SQL_LINE_FRAME}),
 c AS ({_sql_coef(_sql_moments('d', "WHERE split = 'train'"))}),
 p AS (SELECT d.*, a + b1 * l_quantity + b2 * l_discount AS prediction FROM d, c)"""


def _sql_metrics(src, keys):
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS n,
       round_even(1 - sum((revenue - prediction) * (revenue - prediction)) / (var_pop(revenue) * count(*)), 6) AS "R2",
       round_even(sqrt(avg((revenue - prediction) * (revenue - prediction))), 4) AS "RMSE",
       round_even(avg(abs(revenue - prediction)), 4) AS "MAE"
FROM {src} GROUP BY {keys}"""


def _round_metrics(df, keys):
    return df.select(*keys, "n", F.bround("R2", 6).alias("R2"), F.bround("RMSE", 4).alias("RMSE"),
                     F.bround("MAE", 4).alias("MAE"))


@register("ols_coefficients", covers=("M4", "M5", "J7"), sql=f"""
{SQL_BASE}
SELECT 0 AS position, 'intercept' AS feature, round_even(a, 4) AS coef FROM c
UNION ALL SELECT 1, 'l_quantity', round_even(b1, 4) FROM c
UNION ALL SELECT 2, 'l_discount', round_even(b2, 4) FROM c""")
def q_ols_coefficients(spark, base):
    d = _frame(spark, base)
    m = M.fit_ols(S.part(d, "train"), OLS2.features, "revenue")
    return m.coefficients(spark).select("position", "feature", F.bround("coef", 4).alias("coef"))


@register("ols_holdout_metrics", covers=("M8", "M9", "M13", "M18", "J6"), sql=f"""
{SQL_BASE}
{_sql_metrics('p', 'split')}""")
def q_ols_holdout(spark, base):
    d = _frame(spark, base)
    _, met = E.holdout_tagged(d, OLS2, "revenue")
    return _round_metrics(met, ["split"])


SQL_FOLDS = f"""
WITH d AS ({SQL_LINE_FRAME}),
 t AS (SELECT * FROM d WHERE split = 'train'),
 k AS (SELECT DISTINCT fold AS k FROM t),
 tk AS (SELECT k.k, t.* FROM k JOIN t ON t.fold <> k.k),
 c AS ({_sql_coef(_sql_moments('tk', '', 'k'))})"""


@register("cv_fold_metrics", covers=("M12",), sql=f"""
{SQL_FOLDS},
 p AS (SELECT t.*, a + b1 * l_quantity + b2 * l_discount AS prediction FROM t JOIN c ON t.fold = c.k)
{_sql_metrics('p', 'fold')}""")
def q_cv_fold_metrics(spark, base):
    d = S.part(_frame(spark, base), "train")
    return _round_metrics(E.cross_validate(d, OLS2, "revenue"), ["fold"])


@register("cv_summary", covers=("M12", "A23"), sql=f"""
{SQL_FOLDS},
 p AS (SELECT t.*, a + b1 * l_quantity + b2 * l_discount AS prediction FROM t JOIN c ON t.fold = c.k),
 f AS (SELECT fold, 1 - sum((revenue - prediction) * (revenue - prediction)) / (var_pop(revenue) * count(*)) AS r2,
              sqrt(avg((revenue - prediction) * (revenue - prediction))) AS rmse,
              avg(abs(revenue - prediction)) AS mae FROM p GROUP BY fold)
SELECT round_even(avg(r2), 6) AS "CV_R2_mean", round_even(stddev_pop(r2), 6) AS "CV_R2_std",
       round_even(avg(rmse), 4) AS "CV_RMSE_mean", round_even(avg(mae), 4) AS "CV_MAE_mean" FROM f""")
def q_cv_summary(spark, base):
    d = S.part(_frame(spark, base), "train")
    s = E.fold_summary(E.cross_validate(d, OLS2, "revenue"))
    return s.select(F.bround("CV_R2_mean", 6).alias("CV_R2_mean"), F.bround("CV_R2_std", 6).alias("CV_R2_std"),
                    F.bround("CV_RMSE_mean", 4).alias("CV_RMSE_mean"), F.bround("CV_MAE_mean", 4).alias("CV_MAE_mean"))


@register("fold_overfit_gap", covers=("M14",), sql=f"""
{SQL_FOLDS},
 p AS (SELECT c.k, t.*, a + b1 * l_quantity + b2 * l_discount AS prediction,
              CASE WHEN t.fold = c.k THEN 'validation' ELSE 'train' END AS role FROM t, c),
 r AS (SELECT k, role, 1 - sum((revenue - prediction) * (revenue - prediction)) / (var_pop(revenue) * count(*)) AS r2
       FROM p GROUP BY k, role)
SELECT k AS fold, round_even(max(r2) FILTER (WHERE role = 'train'), 6) AS "train_R2",
       round_even(max(r2) FILTER (WHERE role = 'validation'), 6) AS "val_R2",
       round_even(max(r2) FILTER (WHERE role = 'train') - max(r2) FILTER (WHERE role = 'validation'), 6) AS gap
FROM r GROUP BY k""")
def q_fold_gap(spark, base):
    d = S.part(_frame(spark, base), "train")
    g = E.fold_gap(d, OLS2, "revenue")
    return g.select("fold", *[F.bround(c, 6).alias(c) for c in ("train_R2", "val_R2", "gap")])


@register("worst_predictions", covers=("M25", "K2", "P15"), sql=f"""
{SQL_BASE},
 t AS (SELECT li_key, revenue AS actual, prediction AS predicted, revenue - prediction AS diff,
              abs(revenue - prediction) AS abs_error FROM p WHERE split = 'test')
SELECT li_key, round_even(actual, 4) AS actual, round_even(predicted, 4) AS predicted,
       round_even(diff, 4) AS diff, round_even(abs_error, 4) AS abs_error,
       CAST(row_number() OVER (ORDER BY abs_error DESC, li_key) AS INTEGER) AS rank
FROM t ORDER BY abs_error DESC, li_key LIMIT 10""")
def q_worst_predictions(spark, base):
    d = _frame(spark, base)
    fm = M.fit(OLS2, S.part(d, "train"), "revenue")
    w = R.worst_predictions(fm.transform(S.part(d, "test")), "li_key", "revenue", k=10)
    return w.select("li_key", *[F.bround(c, 4).alias(c) for c in ("actual", "predicted", "diff", "abs_error")],
                    F.col("rank").cast("int").alias("rank"))


def _perm_sql(groups: dict) -> str:
    """Importance of a two-regressor OLS by the same shuffles: rows numbered by a salted hash
    of the key, row i taking the contribution of row (a * i + b) mod n."""
    steps = ", ".join(f"({r}, {a}, {b})" for r, (a, b) in enumerate(I.permutation_steps(N_PERM)))
    coef = {"l_quantity": "b1 * l_quantity", "l_discount": "b2 * l_discount"}
    values = ", ".join(f"('{v}', {i}, {len(cs)})" for i, (v, cs) in enumerate(groups.items()))
    parts = ", ".join(" + ".join(coef[c] for c in cs) for cs in groups.values())
    return f"""
{SQL_BASE},
 t AS (SELECT revenue, prediction, [{parts}] AS c,
              row_number() OVER (ORDER BY {sql_hash_int('li_key', 'perm')}, li_key) - 1 AS i, count(*) OVER () AS n
       FROM (SELECT p.*, c.b1, c.b2 FROM p, c WHERE split = 'test')),
 s AS (SELECT * FROM (VALUES {steps}) v(repeat, a, b)),
 g AS (SELECT * FROM (VALUES {values}) v(variable, pos, n_cols)),
 j AS (SELECT g.variable, s.repeat, x.revenue, x.prediction - x.c[g.pos + 1] + y.c[g.pos + 1] AS pp
       FROM t x CROSS JOIN s JOIN t y ON y.i = (s.a::BIGINT * x.i + s.b) % x.n CROSS JOIN g),
 r2 AS (SELECT variable, repeat, 1 - sum((revenue - pp) * (revenue - pp)) / (var_pop(revenue) * count(*)) AS r2
        FROM j GROUP BY variable, repeat),
 b AS (SELECT 1 - sum((revenue - prediction) * (revenue - prediction)) / (var_pop(revenue) * count(*)) AS b FROM t)
SELECT variable, round_even(avg(b - r2), 6) AS importance_mean, round_even(stddev_pop(b - r2), 6) AS importance_std,
       CAST(max(n_cols) AS INTEGER) AS n_cols
FROM r2 JOIN g USING (variable), b GROUP BY variable"""


def _importance(spark, base, groups):
    d = _frame(spark, base)
    fm = M.fit(OLS2, S.part(d, "train"), "revenue")
    imp = I.permutation_importance(S.part(d, "test"), fm, "revenue", groups, "li_key", N_PERM)
    return imp.select("variable", F.bround("importance_mean", 6).alias("importance_mean"),
                      F.bround("importance_std", 6).alias("importance_std"), "n_cols")


PLAIN_GROUPS = {"l_quantity": ["l_quantity"], "l_discount": ["l_discount"]}
JOINT_GROUP = {"both": ["l_quantity", "l_discount"], "l_quantity": ["l_quantity"]}


@register("permutation_importance", covers=("M22",), sql=_perm_sql(PLAIN_GROUPS))
def q_permutation_importance(spark, base):
    return _importance(spark, base, PLAIN_GROUPS)


@register("joint_permutation_importance", covers=("M23",), sql=_perm_sql(JOINT_GROUP))
def q_joint_permutation_importance(spark, base):
    """Two columns shuffled together as one variable, beside one of them alone."""
    return _importance(spark, base, JOINT_GROUP)


@register("importance_joined", covers=("M24",), sql=f"""
WITH imp AS ({_perm_sql(PLAIN_GROUPS)}),
 c AS (SELECT * FROM ({SQL_BASE} SELECT b1, b2 FROM c))
SELECT variable AS feature, round_even(abs(CASE variable WHEN 'l_quantity' THEN b1 ELSE b2 END), 4) AS gain_importance,
       importance_mean AS permutation_importance_mean_R2_drop, importance_std AS permutation_importance_std
FROM imp, c""")
def q_importance_joined(spark, base):
    """Two importances joined by feature name (here the size of the coefficient beside the R² drop)."""
    d = _frame(spark, base)
    fm = M.fit(OLS2, S.part(d, "train"), "revenue")
    own = spark.createDataFrame([(f, abs(float(b))) for f, b in zip(fm.model.features, fm.model.coef)],
                                "feature string, gain_importance double")
    t = I.importance_table(own, _importance(spark, base, PLAIN_GROUPS))
    return t.select("feature", F.bround("gain_importance", 4).alias("gain_importance"),
                    "permutation_importance_mean_R2_drop", "permutation_importance_std")


@register("metric_record", covers=("M10", "M9", "J8"), sql=f"""
{SQL_BASE}
SELECT 'ols_quantity_discount' AS model, 'revenue' AS target, 'l_quantity,l_discount' AS features,
       0.2::DOUBLE AS test_size, 42 AS random_state,
       (SELECT CAST(count(*) AS BIGINT) FROM d WHERE split = 'train') AS n_train,
       CAST(count(*) AS BIGINT) AS n_test,
       round_even(1 - sum((revenue - prediction) * (revenue - prediction)) / (var_pop(revenue) * count(*)), 6) AS "R2",
       round_even(sqrt(avg((revenue - prediction) * (revenue - prediction))), 4) AS "RMSE",
       round_even(avg(abs(revenue - prediction)), 4) AS "MAE"
FROM p WHERE split = 'test'""")
def q_metric_record(spark, base):
    d = _frame(spark, base)
    train, test = S.part(d, "train"), S.part(d, "test")
    fm, met = E.holdout_tagged(d, OLS2, "revenue")
    counts = {r["split"]: r["n"] for r in met.select("split", "n").collect()}
    rec = E.metric_record(OLS2, "revenue", met, counts["train"], counts["test"], 0.2, 42)
    return rec.select("model", "target", "features", "test_size", "random_state", "n_train", "n_test",
                      F.bround("R2", 6).alias("R2"), F.bround("RMSE", 4).alias("RMSE"),
                      F.bround("MAE", 4).alias("MAE"))
