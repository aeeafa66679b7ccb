"""Registered tree-model, search and anomaly queries.

They run on the daily-demand frame derived from the whole lineitem table (one row per
ship date: the shape of the original daily analyses) and on lineitem itself for the
anomaly scoring. Ensembles, searches and shuffles have their full sizes: 300 trees of
unlimited depth, 300 rounds of depth 6, 60 draws x 5 folds over the whole candidate
lists, 30 shuffles. The daily frame is bounded by the calendar, so each fit is one task
and all fits of a table run at once.

Ensembles depend on random streams, so their tables have no SQL twin; the chains around
them are checked with scorers and models that SQL can say.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import label_of, share_percent
from ..operators import anomaly as N
from ..operators import encode as EN
from ..operators import evaluate as E
from ..operators import importance as I
from ..operators import models as M
from ..operators import report as R
from ..operators import rollup
from ..operators import split as S
from ..operators import trees
from ..session import cut_lineage
from ..sources.tables import read_table
from .analysis import comparison, stored_search
from .daily import EVENTS_SPEC, daily_table, hourly_log
from . import sql_forest
from .frames import SQL_DAILY_DEMAND, SQL_LINE_FRAME, daily_demand, line_frame
from .q_models import OLS2, SQL_BASE
from .q_rollup import SQL_COVERAGE, SQL_DAILY
from .registry import register

DIAGNOSTIC = ("n_returned",)          # F10: kept in the frame, never a feature
ORDINAL = EN.FeatureSet("ordinal", ("month", "day", "weekday_ord", "season", "is_weekend", "quantity", "discount",
                                    "price"), DIAGNOSTIC)
TREE = EN.FeatureSet("tree", ("month", "day", "weekday_ord", "season", "is_weekend", "quantity", "discount", "tax",
                              "price"), DIAGNOSTIC)
ONEHOT_CATS = ("season", "weekday")
ONEHOT_NUMS = ("month", "day", "is_weekend", "quantity", "discount", "price")
CUT_YEAR = 2000                       # temporal holdout: train before, test from this year
SPACES = {"forest": M.FOREST_SPACE, "boosted": M.BOOSTED_SPACE}
ANOMALY_FEATURES = ["quantity", "discount", "tax", "price", "cnt"]
SEASONS = {1: "winter", 2: "spring", 3: "summer"}    # a code without a label shows as itself


def _days(spark, base):
    # a row per day of the calendar, read by every step: written once to the shared checkpoint folder
    return cut_lineage(daily_demand(spark, base))


def _daily(spark, base):
    return S.kfold(S.temporal_split(_days(spark, base), "year", CUT_YEAR), "date", 5)


def _onehot(d):
    lv = EN.union_levels([S.part(d, "train"), S.part(d, "test")], list(ONEHOT_CATS))
    out, names = EN.one_hot(d, list(ONEHOT_CATS), level_map=lv, keep_source=True)
    return out, EN.FeatureSet("onehot", (*ONEHOT_NUMS, *names), DIAGNOSTIC).columns


def _search(d, kind, space=None):
    """All draws of one family's search, with their CV R²; kept in the shared folder by what it was made from."""
    train = S.part(d, "train")
    return stored_search(train, kind, TREE.columns, "cnt", space or SPACES[kind])


def _best(d, kind) -> dict:
    return json.loads(_search(d, kind).orderBy(F.col("cv_R2_mean").desc(), "draw").first()["params"])


def _comparison(d, specs):
    """Six models: two linear, two tree families by default and tuned."""
    return comparison(S.part(d, "train"), S.part(d, "test"), specs, "cnt")


def _specs(spark, base):
    d, onehot = _onehot(_daily(spark, base))
    specs = [M.ModelSpec("ols_ordinal", "ols", ORDINAL.columns), M.ModelSpec("ols_onehot", "ols", onehot)]
    for kind in SPACES:
        for name, params in ((kind, {}), (f"{kind}_tuned", _best(d, kind))):
            specs.append(M.ModelSpec(name, kind, TREE.columns, params))
    return d, specs


@register("model_comparison", covers=("M6", "M7", "M8", "M11", "M13", "M15", "M16", "M18", "M19", "F2", "F4", "U2"))
def q_model_comparison(spark, base):
    """CV mean and std beside one holdout for six models, ranked by holdout R²."""
    return _comparison(*_specs(spark, base))


@register("winner_per_metric", covers=("M20", "W5", "K3"))
def q_winner_per_metric(spark, base):
    return E.winners(_comparison(*_specs(spark, base)), {
        "holdout_R2": "max", "holdout_RMSE": "min", "holdout_MAE": "min", "CV_R2_mean": "max"})


@register("cv_holdout_agreement", covers=("M20",))
def q_cv_holdout_agreement(spark, base):
    return E.cv_holdout_agreement(_comparison(*_specs(spark, base)))


def _cv(spark, base, kind):
    d = S.part(_daily(spark, base), "train")
    spec = M.ModelSpec(kind, kind, TREE.columns)
    return E.cross_validate(d, spec, "cnt").join(E.fold_gap(d, spec, "cnt"), "fold")


@register("forest_cv", covers=("M6", "M12", "M14", "A23"))
def q_forest_cv(spark, base):
    """Forest: validation metrics per fold and train-vs-validation gap per fold."""
    return _cv(spark, base, "forest")


@register("boosted_cv", covers=("M7", "M12", "M14", "A23"))
def q_boosted_cv(spark, base):
    return _cv(spark, base, "boosted")


@register("boosted_search", covers=("M15",))
def q_boosted_search(spark, base):
    """Random search for boosted trees, seeded draws, 5-fold CV R², the best one marked."""
    t = _search(_daily(spark, base), "boosted")
    return t.withColumn("best", F.col("cv_R2_mean") == F.max("cv_R2_mean").over(Window.partitionBy()))


@register("forest_search", covers=("M16",))
def q_forest_search(spark, base):
    return _search(_daily(spark, base), "forest")


def _tuning(spark, base, kind):
    d = _daily(spark, base)
    return E.tuning_report(S.part(d, "train"), S.part(d, "test"), kind, TREE.columns, "cnt", _best(d, kind))


@register("forest_tuning_report", covers=("M16", "M17", "M18"))
def q_forest_tuning_report(spark, base):
    """Default vs tuned forest: refit on the training years, holdout once, with CV."""
    return _tuning(spark, base, "forest")


@register("boosted_tuning_report", covers=("M15", "M17", "M18"))
def q_boosted_tuning_report(spark, base):
    return _tuning(spark, base, "boosted")


@register("boosted_importance", covers=("M21", "M22", "M24"))
def q_boosted_importance(spark, base):
    """Gain importance next to permutation importance of the tuned boosted model, by feature name."""
    d = _daily(spark, base)
    fm = M.fit(M.ModelSpec("boosted_tuned", "boosted", TREE.columns, _best(d, "boosted")), S.part(d, "train"), "cnt")
    perm = I.permutation_importance(S.part(d, "test"), fm, "cnt", {f: [f] for f in TREE.columns}, "date")
    return I.importance_table(I.impurity_importance(fm), perm)


# Boosted trees over every line, the usual model in full; the features have few values, so SQL can grow them too.
LINE_FULL = M.ModelSpec("boosted_lines_full", "boosted", ("l_quantity", "l_discount", "l_tax", "ship_month"),
                        {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.3, "reg_lambda": 1.0, "reg_alpha": 0.0,
                         "min_child_weight": 1})
_SQL_FULL = f"""
WITH RECURSIVE d AS MATERIALIZED ({SQL_LINE_FRAME}), tr AS MATERIALIZED (SELECT * FROM d WHERE split = 'train'),
 {sql_forest.boosted_rounds('tr', LINE_FULL.features, 'revenue', 300, 6, 0.3, 1.0, 0.0, 1)}"""

# The importance is that of a few small trees with both penalties.
LINE_BOOSTED = M.ModelSpec("boosted_lines", "boosted", ("l_quantity", "l_discount", "l_tax", "ship_month"),
                           {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.5, "reg_lambda": 1.5, "reg_alpha": 1000.0,
                            "min_child_weight": 200})
_SQL_BOOSTED = f"""
WITH d AS MATERIALIZED ({SQL_LINE_FRAME}), tr AS MATERIALIZED (SELECT * FROM d WHERE split = 'train'),
 {sql_forest.boosted('tr', LINE_BOOSTED.features, 'revenue', 4, 3, 0.5, 1.5, 1000.0, 200)}"""


def _line_splits(spark, base, spec):
    fm = M.fit(spec, S.part(line_frame(spark, base), "train"), "revenue")
    return trees.split_table(fm.model, spark)


@register("boosted_line_splits", covers=("M7", "M8", "M21"), sql=_SQL_FULL + """
SELECT tree, path, feature, round(threshold, 4) AS threshold, weight, round(value, 3) + 0.0 AS value FROM splits""")
def q_boosted_line_splits(spark, base):
    """Every node of 300 rounds of depth 6 over all training lines: its split, its weight and its value."""
    return _line_splits(spark, base, LINE_FULL).select("tree", "path", "feature", F.round("threshold", 4).alias("threshold"), "weight",
                                                       F.round("value", 3).alias("value"))


@register("boosted_line_importance", covers=("M21",), sql=f"""{_SQL_BOOSTED},
 g AS (SELECT feature, avg(gain) AS part FROM splits WHERE feature IS NOT NULL GROUP BY feature)
SELECT n.feature, round(coalesce(part / (SELECT sum(part) FROM g), 0), 6) AS gain_importance
FROM (SELECT unnest([{', '.join(f"'{c}'" for c in LINE_BOOSTED.features)}]) AS feature) n LEFT JOIN g ON g.feature = n.feature""")
def q_boosted_line_importance(spark, base):
    """Gain importance from the split table."""
    imp = trees.gain_importance(_line_splits(spark, base, LINE_BOOSTED), LINE_BOOSTED.features, "boosted")
    return imp.select("feature", F.round("gain_importance", 6).alias("gain_importance"))


def _winner(spark, base):
    """The comparison's best model by holdout R², fitted on the whole training part, and the frame."""
    d, specs = _specs(spark, base)
    name = _comparison(d, specs).orderBy("rank").first()["model"]
    spec = next(s for s in specs if s.name == name)
    return d, spec, M.fit(spec, S.part(d, "train"), "cnt")


@register("winner_importance", covers=("M21", "M22", "M23", "M24"))
def q_winner_importance(spark, base):
    """Permutation importance of the winning model by variable (dummies together), beside gain importance of trees."""
    d, spec, fm = _winner(spark, base)
    dummies = {c: g for c in spec.features if c not in (*ORDINAL.columns, *TREE.columns)
               for g in ONEHOT_CATS if c.startswith(f"{g}_")}
    groups: dict = {}
    for c in spec.features:
        groups.setdefault(dummies.get(c, c), []).append(c)
    perm = I.permutation_importance(S.part(d, "test"), fm, "cnt", groups, "date")
    if spec.kind == "ols":
        return perm.orderBy(F.col("importance_mean").desc())
    return I.importance_table(I.impurity_importance(fm), perm)


@register("winner_worst_errors", covers=("M18", "M25", "J4", "N6", "N7"))
def q_winner_worst_errors(spark, base):
    """The winning model's 10 worst holdout errors, flagged when the day is an anomaly of its own year."""
    d, spec, fm = _winner(spark, base)
    worst = R.worst_predictions(fm.transform(S.part(d, "test")), "date", "cnt", k=10, round_prediction=True)
    anomalies = N.detect_by_period(d, "year", ANOMALY_FEATURES, "date").where("is_outlier")
    return R.flag_membership(worst, anomalies, "date", "is_isoforest_outlier").orderBy("rank")


@register("search_invariants", covers=("M15", "M16"), sql="""
SELECT kind, CAST(60 AS BIGINT) AS n_draws, CAST(60 AS BIGINT) AS n_distinct, TRUE AS best_is_max, CAST(0 AS BIGINT) AS n_null
FROM (VALUES ('boosted'), ('forest')) t(kind)""")
def q_search_invariants(spark, base):
    """60 different draws a family, each with its CV R², and the best one is the one that is refitted."""
    rows, d = None, _daily(spark, base)
    for kind in sorted(SPACES):
        t = _search(d, kind)
        best = F.lit(json.dumps(_best(d, kind), sort_keys=True))
        row = t.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_draws"), F.count_distinct("params").alias("n_distinct"),
                    (F.max(F.when(F.col("params") == best, F.col("cv_R2_mean"))) == F.max("cv_R2_mean")).alias("best_is_max"),
                    F.count_if(F.col("cv_R2_mean").isNull() | F.col("cv_R2_std").isNull()).alias("n_null"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@register("comparison_invariants", covers=("M19", "M20"), sql="""
SELECT CAST(6 AS BIGINT) AS n_models, CAST(0 AS BIGINT) AS n_null, TRUE AS ranked, TRUE AS gap_adds_up""")
def q_comparison_invariants(spark, base):
    """Six models, none without CV or holdout figures, ranked by holdout R²."""
    t = _comparison(*_specs(spark, base))
    missing = F.lit(False)
    for c in t.columns:
        missing = missing | F.col(c).isNull()
    better = F.rank().over(Window.orderBy(F.col("holdout_R2").desc(), "model"))      # six rows
    return t.withColumn("__r", better).agg(
        F.count(F.lit(1)).alias("n_models"), F.count_if(missing).alias("n_null"),
        F.every(F.col("__r") == F.col("rank")).alias("ranked"),
        F.every(F.abs(F.col("overfit_gap") - (F.col("train_R2") - F.col("holdout_R2"))) < 1e-12).alias("gap_adds_up"))


@register("boosted_search_two_years", covers=("M15",))
def q_boosted_search_two_years(spark, base):
    """The search over the second analysis' lists."""
    return _search(_daily(spark, base), "boosted", M.BOOSTED_SPACE_TWO_YEARS)


@register("forest_search_two_years", covers=("M16",))
def q_forest_search_two_years(spark, base):
    return _search(_daily(spark, base), "forest", M.FOREST_SPACE_TWO_YEARS)


@register("grouped_permutation_importance", covers=("M23", "F2"))
def q_grouped_importance(spark, base):
    """One-hot OLS: all dummies of a categorical variable are shuffled together."""
    d, feats = _onehot(_daily(spark, base))
    fm = M.fit(M.ModelSpec("ols_onehot", "ols", feats), S.part(d, "train"), "cnt")
    groups = {c: [c] for c in ONEHOT_NUMS}
    for cat in ONEHOT_CATS:
        groups[cat] = [f for f in feats if f.startswith(f"{cat}_")]
    return I.permutation_importance(S.part(d, "test"), fm, "cnt", groups, "date")


# ---------------------------------------------------------------- winners over three OLS specs

_THREE = {"ols_both": OLS2.features, "ols_quantity": ("l_quantity",), "ols_discount": ("l_discount",)}


def _sql_three() -> str:
    """Holdout R² and RMSE of three linear models over the line frame."""
    rows = []
    for name, f in _THREE.items():
        if len(f) == 2:
            rows.append(f"SELECT '{name}' AS model, revenue AS y, prediction AS p FROM p WHERE split = 'test'")
        else:
            x = f[0]
            rows.append(f"""SELECT '{name}', d.revenue, k.b * d.{x} + k.a FROM d,
              (SELECT regr_slope(revenue, {x}) AS b, regr_intercept(revenue, {x}) AS a FROM d WHERE split = 'train') k
              WHERE d.split = 'test'""")
    return f"""{SQL_BASE},
 s AS ({' UNION ALL '.join(rows)}),
 m AS (SELECT model, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2,
              sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae FROM s GROUP BY model)"""


def _three(spark, base):
    d = line_frame(spark, base)
    rows = None
    for name, f in _THREE.items():
        _, hold = E.holdout_tagged(d, M.ModelSpec(name, "ols", f), "revenue")
        row = E.comparison_row(M.ModelSpec(name, "ols", f), None, hold)
        rows = row if rows is None else rows.unionByName(row)
    return rows


@register("ols_winners", covers=("W5", "K3", "M20"), sql=f"""
{_sql_three()},
 u AS (SELECT 'holdout_R2' AS metric, model, r2 AS v, -r2 AS o FROM m
       UNION ALL SELECT 'holdout_RMSE', model, rmse, rmse FROM m UNION ALL SELECT 'holdout_MAE', model, mae, mae FROM m)
SELECT metric, model, round_even(v, 4) AS value,
       CAST(rank() OVER (PARTITION BY metric ORDER BY o, model) AS INTEGER) AS rank FROM u""")
def q_ols_winners(spark, base):
    w = E.winners(_three(spark, base), {"holdout_R2": "max", "holdout_RMSE": "min", "holdout_MAE": "min"})
    return w.select("metric", "model", F.bround("value", 4).alias("value"), F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------- anomalies

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_anomalies(spark, base, n_trees=100):
    return N.detect(line_frame(spark, base), LINE_FEATURES, "li_key", n_trees=n_trees, contamination=0.05)


@register("isolation_forest", covers=("N1", "N2", "N3"), sql=f"""
WITH d AS MATERIALIZED ({SQL_LINE_FRAME}),
 {sql_forest.ctes('d', 'li_key', LINE_FEATURES, 100)},
 {sql_forest.walk('iso', 'd', 'li_key', LINE_FEATURES, 100)},
 o AS (SELECT quantile_cont(score, 0.05) AS off FROM iso)
SELECT k AS li_key, round(score - off, 6) + 0.0 AS anomaly_score, score < off AS is_outlier FROM iso, o""")
def q_isolation_forest(spark, base):
    """Every lineitem scored by a 100-tree isolation forest; 5 % flagged."""
    out, _ = _line_anomalies(spark, base)
    return out.select("li_key", F.round("anomaly_score", 6).alias("anomaly_score"), "is_outlier")


@register("isolation_forest_invariants", covers=("N1", "N2", "N3", "P16"), sql=f"""
WITH d AS ({SQL_LINE_FRAME}), n AS (SELECT count(*) AS n FROM d)
SELECT CAST(n AS BIGINT) AS n_rows, CAST(100 AS BIGINT) AS n_trees, CAST(0 AS BIGINT) AS n_bad_roots,
       CAST(0 AS BIGINT) AS n_scores_outside, TRUE AS share_is_five_percent FROM n""")
def q_isolation_forest_invariants(spark, base):
    """Rows in = rows out, every root holds the sample, scores lie in [-1, 0), 5 % are flagged."""
    out, model = _line_anomalies(spark, base)
    roots = model.nodes[model.nodes["node"] == 1]
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(roots)).cast("long").alias("n_trees"),
        F.lit(int((roots["size"] != model.sample_size).sum())).cast("long").alias("n_bad_roots"),
        F.count_if((F.col("anomaly_score") + model.offset < -1) | (F.col("anomaly_score") + model.offset >= 0))
        .alias("n_scores_outside"), (F.abs(share_percent("is_outlier") - 5.0) < 0.5).alias("share_is_five_percent"))


def _sql_causes() -> str:
    """The daily anomalies and, feature by feature, what their score gains at the feature's median (``k``: ranked)."""
    fs = ANOMALY_FEATURES
    copies = " UNION ALL ".join(
        f"SELECT CAST(date AS VARCHAR) || '|{i}' AS ak, date, s, {i} AS fi, '{f}' AS f, {f} AS val, med_{f} AS med, "
        + ", ".join(f"med_{g} AS a_{g}" if g == f else f"CAST({g} AS DOUBLE) AS a_{g}" for g in fs) + " FROM a, med"
        for i, f in enumerate(fs))
    return f"""
WITH d AS MATERIALIZED ({SQL_DAILY_DEMAND}),
 {sql_forest.ctes('d', 'date', fs, 300)},
 {sql_forest.walk('iso', 'd', 'date', fs, 300)},
 o AS (SELECT quantile_cont(score, 0.05) AS off FROM iso),
 med AS (SELECT {', '.join(f'quantile_cont(CAST({f} AS DOUBLE), 0.5) AS med_{f}' for f in fs)} FROM d),
 a AS MATERIALIZED (SELECT d.*, score - off AS s FROM d JOIN iso ON iso.k = d.date, o WHERE score < off),
 copies AS MATERIALIZED ({copies}),
 {sql_forest.walk('abl', 'copies', 'ak', [f'a_{f}' for f in fs], 300)},
 r AS (SELECT copies.*, abl.score - off - s AS delta FROM copies JOIN abl ON abl.k = copies.ak, o),
 k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY delta DESC, fi) AS rk FROM r)"""


_SQL_CAUSE_ROWS = f"""SELECT date, round(max(s), 6) + 0.0 AS anomaly_score, max(f) FILTER (rk = 1) AS cause, max(f) FILTER (rk = 2) AS second_cause,
       round(max(val) FILTER (rk = 1), 6) AS cause_value, round(max(med) FILTER (rk = 1), 6) AS cause_median,
       {', '.join(f"round(max(delta) FILTER (f = '{f}'), 6) + 0.0 AS recover_{f}" for f in ANOMALY_FEATURES)}
FROM k GROUP BY date"""


def _causes(days):
    out, model = N.detect(days, ANOMALY_FEATURES, "date", n_trees=300, contamination=0.05)
    rows = N.attribute_causes(out, model, "date")
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@register("anomaly_causes", covers=("N4", "K4", "A16", "U3"), sql=_sql_causes() + _SQL_CAUSE_ROWS)
def q_anomaly_causes(spark, base):
    """Daily demand: anomalies and the feature whose median restores them most."""
    return _causes(_days(spark, base))


@register("anomaly_cause_counts", covers=("N5",), sql=_sql_causes()
          + "SELECT f AS cause, count(*) AS n_outliers FROM k WHERE rk = 1 GROUP BY f")
def q_anomaly_cause_counts(spark, base):
    return N.cause_distribution(_causes(_days(spark, base)))


@register("anomaly_report", covers=("N4", "P13", "K1"), sql=f"""{_sql_causes()}
SELECT c.*, d.cnt, CASE d.season {' '.join(f"WHEN {c} THEN '{n}'" for c, n in SEASONS.items())} ELSE CAST(d.season AS VARCHAR) END AS season
FROM ({_SQL_CAUSE_ROWS}) c JOIN d ON d.date = c.date""")
def q_anomaly_report(spark, base):
    """Anomalous days by score with cause, count and the season's label (codes without one show as they are)."""
    d = _days(spark, base)
    rows = _causes(d).join(d.select("date", "cnt", "season"), "date")
    return rows.withColumn("season", label_of("season", SEASONS)).orderBy("anomaly_score")


# A scorer that SQL can say: minus the largest distance to the centre in units of 1000ths of
# fixed ranges; lower is more abnormal, as with the forest.
_RANGES = {"l_quantity": (25.0, 25.0), "l_discount": (0.05, 0.05), "l_tax": (0.04, 0.04)}


def _distance(cols):
    return -sum((F.round(F.abs(F.col(c) - mid) / half * 1000) for c, (mid, half) in zip(cols, _RANGES.values())),
                F.lit(0.0))


def _scored_lines(spark, base):
    d = line_frame(spark, base).withColumn("__s", _distance(_RANGES))
    model = N.IsolationForestModel(list(_RANGES), 0, 0, None)
    model.offset = N.threshold(d, 0.05, "__s")
    out = d.withColumn("anomaly_score", F.col("__s") - F.lit(model.offset)).withColumn(
        "is_outlier", F.col("anomaly_score") < 0).drop("__s")

    def scorer(df, features, name):
        return df.withColumn(name, _distance(features) - F.lit(model.offset))
    return out, model, scorer


_SQL_TERMS = {c: f"round(abs({{x}} - {m}) / {h} * 1000)" for c, (m, h) in _RANGES.items()}
_SQL_SCORED = f"""
WITH d AS ({SQL_LINE_FRAME}),
 s AS (SELECT *, {', '.join(t.format(x=c) + f' AS t_{c}' for c, t in _SQL_TERMS.items())} FROM d),
 z AS (SELECT *, -({' + '.join(f't_{c}' for c in _RANGES)}) AS sc FROM s),
 o AS (SELECT quantile_cont(sc, 0.05) AS off, {', '.join(f'quantile_cont({c}, 0.5) AS med_{c}' for c in _RANGES)} FROM z),
 a AS (SELECT z.*, o.*, sc - off AS score FROM z, o WHERE sc < off),
 r AS (SELECT *, {', '.join(f"t_{c} - {t.format(x=f'med_{c}')} AS rec_{c}" for c, t in _SQL_TERMS.items())} FROM a),
 u AS ({' UNION ALL '.join(f"SELECT li_key, score, '{c}' AS f, {i} AS fi, rec_{c} AS rec, {c} AS val, med_{c} AS med FROM r"
                           for i, c in enumerate(_RANGES))}),
 k AS (SELECT *, row_number() OVER (PARTITION BY li_key ORDER BY rec DESC, fi) AS rk FROM u)"""


@register("cause_by_ablation", covers=("N3", "N4", "K4", "U3", "A16"), sql=f"""
{_SQL_SCORED}
SELECT li_key, max(score) AS anomaly_score, max(f) FILTER (rk = 1) AS cause, max(f) FILTER (rk = 2) AS second_cause,
       max(val) FILTER (rk = 1) AS cause_value, max(med) FILTER (rk = 1) AS cause_median,
       {', '.join(f"max(rec) FILTER (f = '{c}') AS recover_{c}" for c in _RANGES)}
FROM k GROUP BY li_key""")
def q_cause_by_ablation(spark, base):
    """Median ablation with a supplied scorer over every flagged line."""
    out, model, scorer = _scored_lines(spark, base)
    return N.attribute_causes(out, model, "li_key", scorer=scorer)


@register("cause_counts_by_ablation", covers=("N5", "A12"), sql=f"""
{_SQL_SCORED}
SELECT f AS cause, count(*) AS n_outliers FROM k WHERE rk = 1 GROUP BY f""")
def q_cause_counts(spark, base):
    out, model, scorer = _scored_lines(spark, base)
    return N.cause_distribution(N.attribute_causes(out, model, "li_key", scorer=scorer))


@register("anomalies_by_period", covers=("N6",), sql=f"""
WITH d AS MATERIALIZED ({SQL_DAILY_DEMAND}),
 {sql_forest.ctes('d', 'date', ANOMALY_FEATURES, 100, 'year')},
 {sql_forest.walk('iso', 'd', 'date', ANOMALY_FEATURES, 100, 'year')},
 o AS (SELECT period, quantile_cont(score, 0.05) AS off FROM iso GROUP BY period)
SELECT iso.period AS year, k AS date, round(score - off, 6) + 0.0 AS anomaly_score, score < off AS is_outlier
FROM iso JOIN o ON o.period = iso.period""")
def q_anomalies_by_period(spark, base):
    """Each year's days scored against that year's own distribution."""
    out = N.detect_by_period(_days(spark, base), "year", ANOMALY_FEATURES, "date", n_trees=100, contamination=0.05)
    return out.select("year", "date", F.round("anomaly_score", 6).alias("anomaly_score"), "is_outlier")


@register("anomaly_error_overlap", covers=("N7", "J4", "P8", "P17", "M25"))
def q_anomaly_error_overlap(spark, base):
    """Worst 10 holdout errors of the ordinal OLS, flagged when the day is an anomaly of its own year."""
    d = _daily(spark, base)
    fm = M.fit(M.ModelSpec("ols_ordinal", "ols", ORDINAL.columns), S.part(d, "train"), "cnt")
    worst = R.worst_predictions(fm.transform(S.part(d, "test")), "date", "cnt", k=10, round_prediction=True)
    anomalies = N.detect_by_period(d, "year", ANOMALY_FEATURES, "date",
                                   n_trees=100, contamination=0.05).where("is_outlier")
    return R.flag_membership(worst, anomalies, "date", "is_isoforest_outlier").orderBy("rank")


_SQL_WORST = f"""
{SQL_BASE},
 w AS (SELECT li_key, split, revenue AS actual, CAST(round_even(prediction, 0) AS BIGINT) AS predicted FROM p),
 e AS (SELECT *, actual - predicted AS diff, abs(actual - predicted) AS abs_error FROM w),
 t AS (SELECT *, CAST(row_number() OVER (ORDER BY abs_error DESC, li_key) AS INTEGER) AS rank
       FROM e ORDER BY abs_error DESC, li_key LIMIT 100),
 flagged AS (SELECT li_key FROM p WHERE l_quantity >= 49),
 few AS (SELECT li_key FROM p WHERE l_discount < 0.01)"""


def _worst_lines(spark, base):
    d = line_frame(spark, base)
    fm = M.fit(OLS2, S.part(d, "train"), "revenue")
    worst = R.worst_predictions(fm.transform(d), "li_key", "revenue", k=100, round_prediction=True, extra=("split",))
    return d, worst


@register("worst_errors_flagged", covers=("M25", "J4", "J9", "P8", "P15", "P17"), sql=f"""
{_SQL_WORST}
SELECT rank, li_key, split, round_even(actual, 4) AS actual, predicted, round_even(diff, 4) AS diff,
       li_key IN (SELECT li_key FROM flagged) AS is_flagged, li_key IN (SELECT li_key FROM few) AS is_low
FROM t""")
def q_worst_errors_flagged(spark, base):
    """Worst errors over the whole frame with their split, flagged by two row sets."""
    d, worst = _worst_lines(spark, base)
    out = R.flag_membership(worst, d.where("l_quantity >= 49"), "li_key", "is_flagged")
    out = R.flag_membership(out, d.where("l_discount < 0.01"), "li_key", "is_low")
    return out.select(F.col("rank").cast("int").alias("rank"), "li_key", "split", F.bround("actual", 4).alias("actual"),
                      "predicted", F.bround("diff", 4).alias("diff"), "is_flagged", "is_low")


@register("error_overlap_set", covers=("J5", "J6"), sql=f"""
{_SQL_WORST}
SELECT 'flagged' AS split, li_key FROM t WHERE li_key IN (SELECT li_key FROM flagged)
UNION ALL SELECT 'low', li_key FROM t WHERE li_key IN (SELECT li_key FROM few)""")
def q_error_overlap_set(spark, base):
    """The worst errors' keys that are also in each of the two row sets."""
    d, worst = _worst_lines(spark, base)
    return R.tag_union({"flagged": R.overlap(worst, d.where("l_quantity >= 49"), "li_key"),
                        "low": R.overlap(worst, d.where("l_discount < 0.01"), "li_key")})


TRAIN_DAYS = 24                       # of each series, the days after are its holdout


def low_coverage_overlap(worst, anomalies, cov, key: str):
    """Every worst error or anomaly, flagged as each and by missing hours of its day."""
    days = worst.select(key).union(anomalies.select(key)).distinct()
    days = R.flag_membership(days, worst, key, "is_worst_error")
    days = R.flag_membership(days, anomalies, key, "is_anomaly")
    days = R.flag_membership(days, cov.where("hours_missing > 0"), key, "is_low_coverage")
    return days.join(cov, key)


@register("low_coverage_overlap", covers=("N7", "J4", "P8", "P17"), sql=f"""
WITH d AS ({SQL_DAILY}),
 m AS (SELECT regr_slope(cnt, reading) AS b, regr_intercept(cnt, reading) AS a FROM d WHERE instant <= {TRAIN_DAYS}),
 e AS (SELECT series, date, abs(cnt - CAST(round_even(a + b * reading, 0) AS BIGINT)) AS err FROM d, m
       WHERE instant > {TRAIN_DAYS}),
 t AS (SELECT series, date FROM e ORDER BY err DESC, series, date LIMIT 10),
 s AS (SELECT series, date, -round(abs(cnt - avg(cnt) OVER (PARTITION BY series)) * 1000) AS sc FROM d),
 o AS (SELECT series, date FROM s WHERE sc < (SELECT quantile_cont(sc, 0.05) FROM s)),
 c AS ({SQL_COVERAGE})
SELECT c.series, c.date, t.date IS NOT NULL AS is_worst_error, o.date IS NOT NULL AS is_anomaly,
       c.hours_missing > 0 AS is_low_coverage, c.hours_missing
FROM c LEFT JOIN t ON t.series = c.series AND t.date = c.date LEFT JOIN o ON o.series = c.series AND o.date = c.date
WHERE t.date IS NOT NULL OR o.date IS NOT NULL""")
def q_low_coverage_overlap(spark, base):
    """Worst 10 holdout errors of the daily count, and its anomalous days, beside the hours missing then."""
    hourly = hourly_log(read_table(spark, base, "events"))
    keyed = lambda df: df.withColumn("series_day", F.concat_ws("|", "series", "date"))
    d = keyed(daily_table(hourly))
    fm = M.fit(M.ModelSpec("ols_reading", "ols", ("reading",)), d.where(F.col("instant") <= TRAIN_DAYS), "cnt")
    worst = R.worst_predictions(fm.transform(d.where(F.col("instant") > TRAIN_DAYS)), "series_day", "cnt", k=10,
                                round_prediction=True)
    mean = F.avg("cnt").over(Window.partitionBy("series"))
    scored = d.withColumn("__s", -F.round(F.abs(F.col("cnt") - mean) * 1000))
    anomalies = scored.where(F.col("__s") < F.lit(N.threshold(scored, 0.05, "__s")))
    out = low_coverage_overlap(worst, anomalies, keyed(rollup.coverage(hourly, EVENTS_SPEC)), "series_day")
    return out.select("series", "date", "is_worst_error", "is_anomaly", "is_low_coverage", "hours_missing")
