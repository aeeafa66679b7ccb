"""Isolation forests with a cause per anomaly.

Every random choice is an md5 of the seed, the tree and the row or node, so a forest is a function of the
data: the same under any partitioning and after a lost executor, and other engines can grow it
again (``plans.sql_forest`` does in SQL).

* Sampling (N1): of each period the ``pool_rows`` rows with the smallest hashes, and of
  these for each tree the ``sample_size`` with the smallest hashes of (tree, row). Counts by leading bits of the
  hash say which rows can be in the pool, so only about as many as it holds are shuffled and ranked.
* Building (N1, N6): ``groupBy(period, tree).applyInPandas`` - one job grows the trees of all
  periods, each from its small sample. Nodes are numbered as in a heap (children 2i and 2i + 1). A node
  picks one of its features with more than one value, and a place between its least and largest value.
* Nodes (N1): a table (period, tree, node, feature, threshold, size, depth) of at most
  ``n_trees x (2 sample_size - 1)`` rows per period: a function of the parameters, not of the data.
* Scoring (N2): an Arrow ``pandas_udf`` walks all trees of a row's period, whole batches at a time. Periods
  are scored in blocks, so that the broadcast nodes are bounded. Path lengths are summed in whole
  billionths, so equal rows have equal scores whatever the order of trees.
* Threshold (N3): the contamination quantile of each period's scores, exact.
* Causes (N4): outliers x features are exploded, each copy gets one feature set
  to its median, all copies are scored in one pass, the largest recovery wins
  (ties: feature order), runner-up kept.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_int
from ..session import cut_lineage

EULER_GAMMA = 0.5772156649015329
BILLION = 1_000_000_000
SPACE = float(16 ** 15)
POOL = 64                    # rows of the pool for each row of a sample
PERIODS_AT_ONCE = 64         # periods whose nodes are broadcast together
SLOT_BITS = 44               # of the 60 bits of a hash: those below the 65,536 slots it is counted in


def avg_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


NODE_FIELDS = "tree int, node int, feature int, threshold double, size bigint, depth int"


def node_numbers(seed: int, tree: int, node: int) -> tuple[float, int]:
    """A node's place between 0 and 1, and the number that picks its feature."""
    h = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(h[:15], 16) / SPACE, int(h[15:30], 16)


def _build_tree(x: np.ndarray, seed: int, tree: int, max_depth: int) -> list:
    """(node, feature, threshold, size, depth) of one tree; a leaf's feature is -1."""
    out, open_ = [], [(1, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        depth = node.bit_length() - 1
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or not len(usable):
            out.append((node, -1, 0.0, len(rows), depth))
            continue
        place, pick = node_numbers(seed, tree, node)
        f = int(usable[pick % len(usable)])
        at = float(lo[f] + (hi[f] - lo[f]) * place)
        out.append((node, f, at, len(rows), depth))
        left = x[rows, f] < at
        open_ += [(2 * node + side, part) for side, part in ((0, rows[left]), (1, rows[~left])) if len(part)]
    return out


def max_depth(sample_size: int) -> int:
    return int(math.ceil(math.log2(max(sample_size, 2))))


@dataclass
class IsolationForestModel:
    features: list
    n_trees: int
    sample_size: int
    nodes: pd.DataFrame            # __period, tree, node, feature, threshold, size, depth
    offset: float | None = None    # score threshold at the contamination quantile (one period)
    sizes: dict = field(default_factory=dict)     # rows of a sample, by period

    def arrays(self, period=None):
        """Arrays [tree, node] for the walk: feature (-1 at a leaf), threshold, path length in billionths."""
        nd = self.nodes if period is None else self.nodes[self.nodes["__period"] == period]
        shape = (self.n_trees, 2 << max_depth(self.sample_size))
        feature, threshold, length = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int64)
        t, n = nd["tree"].to_numpy(), nd["node"].to_numpy()
        feature[t, n], threshold[t, n] = nd["feature"].to_numpy(), nd["threshold"].to_numpy()
        length[t, n] = nd["depth"].to_numpy(np.int64) * BILLION + np.rint(avg_path_length(nd["size"].to_numpy()) * BILLION).astype(np.int64)
        return feature, threshold, length


def path_lengths(arrays, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of each row's path length, in billionths."""
    feature, threshold, length = arrays
    total = np.zeros(len(x), np.int64)
    for t in range(len(feature)):
        node = np.ones(len(x), np.int64)
        rows = np.flatnonzero(feature[t, node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = 2 * at + (x[rows, feature[t, at]] >= threshold[t, at])
            rows = rows[feature[t, node[rows]] >= 0]
        total += length[t, node]
    return total


def pool_candidates(base: DataFrame, rows: int) -> DataFrame:
    """Rows of (__period, __key, __h, ...) among which are each period's ``rows`` smallest by (__h, __key): those in
    the slots of the hash up to the one that fills the pool. Of a key that repeats in a slot, a task keeps ``rows``."""
    slot = F.coalesce(F.shiftright("__h", SLOT_BITS), F.lit(-1))           # a NULL key sorts first
    counts = base.groupBy("__period", slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__period").orderBy("__slot")) - F.col("__n")
    last = counts.withColumn("__before", before).where(F.col("__before") < rows).groupBy(
        F.col("__period").alias("__of")).agg(F.max("__slot").alias("__last"))
    near = base.join(F.broadcast(last), F.col("__period").eqNullSafe(F.col("__of"))).where(slot <= F.col("__last")).drop("__of", "__last")
    w = Window.partitionBy("__period", "__task").orderBy("__h", "__key")
    return near.withColumn("__task", F.spark_partition_id()).withColumn("__r", F.row_number().over(w)).where(
        F.col("__r") <= rows).drop("__r", "__task")


def sample_for_trees(df: DataFrame, features, key, n_trees: int, sample_size: int, seed: int,
                     period=None) -> DataFrame:
    """(__period, tree, __key, features...): every tree's sample of min(sample_size, n) rows of each period."""
    keyc = F.col(key) if isinstance(key, str) else key
    base = df.select((F.col(period) if period else F.lit(0)).alias("__period"), keyc.alias("__key"),
                     *[F.col(c).cast("double").alias(c) for c in features])
    near = pool_candidates(base.withColumn("__h", hash_int("__key", f"pool|{seed}")), POOL * sample_size)
    w = Window.partitionBy("__period").orderBy("__h", "__key")
    pool = near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= POOL * sample_size).drop("__r", "__h")
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    own = hash_int(F.concat_ws("|", F.col("tree").cast("string"), F.col("__key").cast("string")), f"tree|{seed}")
    w = Window.partitionBy("__period", "tree").orderBy(own, "__key")
    return each.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= sample_size).drop("__r")


def fit_isolation_forest(df: DataFrame, features, key, n_trees: int = 100, sample_size: int = 256,
                         seed: int = 42, period: str | None = None) -> IsolationForestModel:
    """``n_trees`` isolation trees for every period, in one job; the bounded node table is collected."""
    features = list(features)
    sample = sample_for_trees(df, features, key, n_trees, sample_size, seed, period)
    kind = sample.schema["__period"].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("__key", kind="stable")[features].to_numpy(dtype=float)
        rows = _build_tree(x, seed, tree, max_depth(len(x)))
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "size", "depth"])
        out.insert(0, "tree", tree)
        out.insert(0, "__period", pdf["__period"].iloc[0])
        return out
    nodes = sample.groupBy("__period", "tree").applyInPandas(build, f"__period {kind}, {NODE_FIELDS}").toPandas()
    sizes = nodes[nodes["node"] == 1].groupby("__period", dropna=False)["size"].max().to_dict()
    return IsolationForestModel(features, n_trees, max(sizes.values(), default=sample_size), nodes, None, sizes)


def score(df: DataFrame, model: IsolationForestModel, out: str = "score_samples",
          features=None, period: str | None = None) -> DataFrame:
    """``score_samples`` = -2^(-E[h]/c(psi)); lower is more abnormal. With ``period`` each row meets
    the forest of its own period."""
    feats = list(features or model.features)
    every = sorted(model.sizes)
    done = None
    for a in range(0, max(len(every), 1), PERIODS_AT_ONCE):
        some = every[a:a + PERIODS_AT_ONCE]
        shared = df.sparkSession.sparkContext.broadcast(
            {p: (model.arrays(p), float(avg_path_length([model.sizes[p]])[0])) for p in some})

        @F.pandas_udf(T.DoubleType())
        def _score(which: pd.Series, *cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            result = np.zeros(len(x))
            for p, rows in which.groupby(which).indices.items():
                arrays, c = shared.value[p]
                result[rows] = -np.power(2.0, -(path_lengths(arrays, x[rows]) / (BILLION * float(len(arrays[0])))) / max(c, 1e-300))
            return pd.Series(result)
        part = df if len(every) <= PERIODS_AT_ONCE else df.where(F.col(period).isin(some))
        which = F.col(period) if period else F.lit(0)
        part = part.withColumn(out, _score(which, *[F.col(c).cast("double") for c in feats]))
        done = part if done is None else done.unionByName(part)
    return done


def threshold(scored: DataFrame, contamination: float = 0.05, col: str = "score_samples") -> float:
    """Score at the contamination quantile (linear interpolation), exact at any size."""
    from .profile import exact_quantile
    return float(exact_quantile(scored, col, contamination))


def detect(df: DataFrame, features, key, n_trees: int = 100, contamination: float = 0.05,
           sample_size: int = 256, seed: int = 42) -> tuple[DataFrame, IsolationForestModel]:
    """Adds ``anomaly_score`` (decision value; negative = outlier) and ``is_outlier``."""
    model = fit_isolation_forest(df, features, key, n_trees, sample_size, seed)
    # read twice (threshold, result): written once to the shared checkpoint folder
    scored = cut_lineage(score(df, model))
    model.offset = threshold(scored, contamination)
    return _decided(scored.withColumn("__offset", F.lit(model.offset))), model


def _decided(scored: DataFrame) -> DataFrame:
    return scored.withColumn("anomaly_score", F.col("score_samples") - F.col("__offset")).withColumn(
        "is_outlier", F.col("anomaly_score") < 0).drop("score_samples", "__offset")


def medians(df: DataFrame, features) -> dict:
    """Per-feature median (linear interpolation), exact at any size."""
    from .profile import wide_quantiles
    rows = wide_quantiles(df, features, [0.5]).collect()
    return {r["column"]: float(r["value"]) for r in rows}


def forest_scorer(model: IsolationForestModel):
    """The forest as a scorer — a function adding a decision value column."""
    def scorer(df: DataFrame, features, out: str) -> DataFrame:
        s = score(df, model, "__s", features=features)
        return s.withColumn(out, F.col("__s") - F.lit(model.offset)).drop("__s")
    return scorer


def attribute_causes(detected: DataFrame, model: IsolationForestModel, key: str,
                     med: dict | None = None, scorer=None) -> DataFrame:
    """Median ablation per outlier and feature, in one scoring pass.

    ``scorer(df, feature_columns, out)`` adds a decision value (U3); by default the
    forest's own. Output per outlier: key, anomaly_score, cause, second_cause,
    cause value and median, and ``recover_<feature>`` for every feature.
    """
    scorer = scorer or forest_scorer(model)
    feats = model.features
    med = med or medians(detected, feats)
    out = detected.where("is_outlier")
    copies = out.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.lit(f).alias("fname"))
                                                  for i, f in enumerate(feats)])).alias("__abl"))
    copies = copies.select("*", "__abl.fi", "__abl.fname").drop("__abl")
    for f in feats:
        copies = copies.withColumn(f"__x_{f}", F.when(F.col("fname") == f, F.lit(med[f]))
                                   .otherwise(F.col(f).cast("double")))
    rescored = scorer(copies, [f"__x_{f}" for f in feats], "__new")
    rescored = rescored.withColumn("delta", F.col("__new") - F.col("anomaly_score"))
    w = Window.partitionBy(key).orderBy(F.col("delta").desc(), F.col("fi"))
    ranked = rescored.withColumn("__rk", F.row_number().over(w))
    piv = ranked.groupBy(key).agg(
        F.first("anomaly_score").alias("anomaly_score"),
        F.max(F.when(F.col("__rk") == 1, F.col("fname"))).alias("cause"),
        F.max(F.when(F.col("__rk") == 2, F.col("fname"))).alias("second_cause"),
        *[F.max(F.when(F.col("fname") == f, F.col("delta"))).alias(f"recover_{f}") for f in feats])
    value_of = None
    for f in feats:
        value_of = (F.when(F.col("cause") == f, F.col(f).cast("double")) if value_of is None
                    else value_of.when(F.col("cause") == f, F.col(f).cast("double")))
    med_of = None
    for f in feats:
        med_of = (F.when(F.col("cause") == f, F.lit(med[f])) if med_of is None
                  else med_of.when(F.col("cause") == f, F.lit(med[f])))
    orig = out.select(key, *feats)
    return piv.join(orig, key).withColumn("cause_value", value_of).withColumn("cause_median", med_of) \
        .select(key, "anomaly_score", "cause", "second_cause", "cause_value", "cause_median",
                *[f"recover_{f}" for f in feats])


def cause_distribution(causes: DataFrame) -> DataFrame:
    """How many anomalies each feature explains."""
    return causes.groupBy("cause").agg(F.count(F.lit(1)).alias("n_outliers"))


def detect_by_period(df: DataFrame, period_col: str, features, key, n_trees: int = 100,
                     contamination: float = 0.05, sample_size: int = 256, seed: int = 42) -> DataFrame:
    """Each period's rows scored on their own distribution: one job grows the forests of all periods, one
    pass scores all rows, one finds all thresholds. Rows without a period take no part."""
    from .profile import exact_quantiles
    have = df.where(F.col(period_col).isNotNull())
    model = fit_isolation_forest(have, features, key, n_trees, sample_size, seed, period_col)
    scored = cut_lineage(score(have, model, period=period_col))
    cut = exact_quantiles(scored, "score_samples", [contamination], keys=[period_col]).select(
        F.col(period_col).alias("__p"), F.col("value").alias("__offset"))
    return _decided(scored.join(cut, F.col(period_col) == F.col("__p")).drop("__p"))
