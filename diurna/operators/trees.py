"""Tree ensembles grown from exact partial sums.

Features are binned once (exact bins while distinct values are few), the target is held in
whole units of 2^-30 of its range, and every random choice - bootstrap weights, row and
column samples, the features tried at a node - is a hash of the row, tree and node. Sums over
rows are therefore whole numbers, the same in any order, and a fit gives the same trees whatever
the partitioning, after a lost executor, and whichever way it is grown:

* *Large nodes, level by level on Spark.* Each task walks its rows down the partial trees and
  sums weight and gradient by (node, feature, bin); Spark adds these up, takes running sums over the
  bins and keeps the best split of each node. All trees of all fits advance together, a scan per
  level; finished ones leave.
* *Small nodes at once.* A node of at most ``local_rows`` rows is sent to one task, which
  finishes its subtree. A frame that is itself so small (a daily table, bounded by the calendar)
  is broadcast, and the fits of a search are what is spread over the cluster.
* *Boosting that counts every row in every tree.* Rows with the same codes end in the same leaf of every tree, so
  a large frame is kept as a row per combination of codes, with their number and the sum of their targets. Up to
  ``MERGED_ROWS`` combinations one task goes through all rounds; more are grown level by level, as above.

Boosting uses the second-order form for squared error: with the sum of residuals G, the weight H, and the
squared and absolute penalties lambda and alpha, a leaf is rate * s(G) / (H + lambda), s shrinking by alpha,
and a split gains s(GL)^2 / (HL + lambda) + s(GR)^2 / (HR + lambda) - s(G)^2 / (H + lambda).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import qcol
from ..session import cut_lineage, dropped, scratch_path

# The usual defaults of the two regressors.
FOREST_DEFAULTS = {"n_estimators": 300, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1,
                   "max_features": 1.0}
BOOSTED_DEFAULTS = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0,
                    "colsample_bytree": 1.0, "min_child_weight": 1, "reg_alpha": 0.0, "reg_lambda": 1.0}
MAX_BINS = 256
RULES = 1                  # to be raised when the same fit would give other trees; part of the name of stored results
LOCAL_ROWS = 20_000        # bound of what one task finishes, and of a frame that is broadcast
MERGED_ROWS = 200_000      # bound of the combinations of codes that one task boosts: below it, jobs for each round cost more
_UNIT_BITS = 30
_CELLS = 1_000_000         # rows x trees walked at once
_SIDE_BY_SIDE = 500_000    # rows x features x trees grown at once
_FEW_CELLS = 1 << 16       # sums by (node, feature, bin) that a task keeps over all its batches


# ---- random choices by hash ---------------------------------------------------------------

def _mixed(x: np.ndarray, salt) -> np.ndarray:
    """64-bit finaliser of x with a salt."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _uniform(x: np.ndarray, salt) -> np.ndarray:
    return (_mixed(x, salt) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 18)]))


def _child(path: np.ndarray, side) -> np.ndarray:
    return _mixed(path, np.asarray(side, np.uint64) + np.uint64(1))


def _ranks(path: np.ndarray, many: int) -> np.ndarray:
    """(nodes, features): the order of the features at each node."""
    keys = _mixed(path[:, None], np.arange(10, 10 + many, dtype=np.uint64)[None, :])
    return keys.argsort(axis=1, kind="stable").argsort(axis=1)


# ---- fits and models ----------------------------------------------------------------------

def _share(v, n: int) -> int:
    """Number of features that a setting like "sqrt", "log2", 0.5 or 1.0 stands for."""
    if v == "sqrt":
        return max(1, int(np.sqrt(n)))
    if v == "log2":
        return max(1, int(np.log2(n)))
    return max(1, int(v * n))


@dataclass(frozen=True)
class Fit:
    """One ensemble: its kind, parameters, and the folds kept out of it."""
    kind: str
    params: dict = field(default_factory=dict)
    without: tuple = ()
    seed: int = 42

    def __getitem__(self, name):
        return {**(FOREST_DEFAULTS if self.kind == "forest" else BOOSTED_DEFAULTS), **self.params}.get(name)

    @property
    def depth(self) -> int:
        return 10_000 if self["max_depth"] is None else int(self["max_depth"])

    @property
    def child(self) -> int:
        return int(self["min_samples_leaf"] if self.kind == "forest" else self["min_child_weight"])

    @property
    def least(self) -> int:
        return max(2, int(self["min_samples_split"])) if self.kind == "forest" else 2

    def penalties(self, unit: float) -> tuple[float, float]:
        """(lambda, alpha), alpha in the target's units."""
        return (0.0, 0.0) if self.kind == "forest" else (float(self["reg_lambda"]), float(self["reg_alpha"]) / unit)

    @property
    def whole(self) -> bool:
        """Whether every row counts once in every tree."""
        return self.kind == "boosted" and self["subsample"] >= 1

    def root(self, tree: int) -> np.ndarray:
        return _mixed(np.array([tree], np.uint64), self.seed)

    def weights(self, h: np.ndarray, fold: np.ndarray, tree: int) -> np.ndarray:
        """How often each row counts in a tree."""
        salt = _mixed(np.array([tree], np.uint64), self.seed + 1)[0]
        if self.kind == "forest":
            w = np.searchsorted(_POISSON, _uniform(h, salt), side="right")
        else:
            w = (_uniform(h, salt) < self["subsample"]).astype(np.int64) if self["subsample"] < 1 else np.ones(len(h), np.int64)
        return np.where(np.isin(fold, self.without), 0, w) if self.without else w

    def allowed(self, path: np.ndarray, tree: int, many: int) -> np.ndarray:
        """(nodes, features): which features each node may split on."""
        if self.kind == "forest":
            return _ranks(path, many) < _share(self["max_features"], many)
        some = max(1, int(self["colsample_bytree"] * many))
        return np.broadcast_to(_ranks(self.root(tree), many) < some, (len(path), many))


@dataclass
class Tree:
    feature: np.ndarray      # -1 at a leaf
    bin: np.ndarray          # rows with a code at or below it go left
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    weight: np.ndarray       # of the node's rows
    total: np.ndarray        # of their weighted gradients, whole units
    gain: np.ndarray         # of the split, 0 at a leaf

    FIELDS = ("feature", "bin", "left", "right", "depth", "weight", "total", "gain")

    def fields(self) -> list:
        return [getattr(self, f) for f in self.FIELDS]


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


class Walk:
    """All trees of an ensemble side by side, for rows of bin codes."""

    def __init__(self, trees: list):
        size = [len(t.feature) for t in trees]
        self.roots = np.cumsum(size) - size
        base = np.repeat(self.roots, size)
        join = lambda f: np.concatenate([getattr(t, f) for t in trees]) if trees else np.zeros(0, np.int64)
        self.feature, self.bin, self.depth, self.weight, self.total = map(join, ("feature", "bin", "depth", "weight", "total"))
        self.left, self.right = join("left") + base, join("right") + base

    def ends(self, codes: np.ndarray, max_depth: int = 10_000, least: int = 0) -> np.ndarray:
        """(rows, trees): the node where each row ends, in trees cut at a depth and a least weight."""
        node = np.broadcast_to(self.roots, (len(codes), len(self.roots))).copy()
        go = (self.feature >= 0) & (self.depth < max_depth) & (self.weight >= least)
        r, t = np.nonzero(go[node])
        while len(r):
            at = node[r, t]
            at = np.where(codes[r, self.feature[at]] <= self.bin[at], self.left[at], self.right[at])
            node[r, t] = at
            on = go[at]
            r, t = r[on], t[on]
        return node


@dataclass
class Ensemble:
    features: list
    cuts: list               # ascending cut values of each feature
    unit: float              # of the target
    fit: Fit
    base: int                # boosting's first prediction, whole units
    trees: list

    def codes(self, x: np.ndarray) -> np.ndarray:
        return coded(x, self.cuts)

    def leaf_values(self, walk: Walk) -> np.ndarray:
        return _leaf_values(self.fit, self.unit, walk.total, walk.weight)

    def predict_codes(self, codes: np.ndarray) -> np.ndarray:
        walk = Walk(self.trees)
        value, step = self.leaf_values(walk), max(1, _CELLS // max(len(self.trees), 1))
        out = np.zeros(len(codes))
        for a in range(0, len(codes) if self.trees else 0, step):
            out[a:a + step] = value[walk.ends(codes[a:a + step])].sum(axis=1)
        return (out / max(len(self.trees), 1) if self.fit.kind == "forest" else self.base + out) * self.unit

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_codes(self.codes(x))

    def node_rows(self) -> pd.DataFrame:
        """The split table: a row per node with its way from the root (L, R), thresholds as values."""
        rows = []
        for i, t in enumerate(self.trees):
            path = [""] * len(t.feature)
            for j in np.flatnonzero(t.feature >= 0).tolist():         # parents stand before their children
                path[t.left[j]], path[t.right[j]] = path[j] + "L", path[j] + "R"
            walk = Walk([t])
            cut = [float(self.cuts[f][b]) if f >= 0 else None for f, b in zip(t.feature, t.bin)]
            name = [self.features[f] if f >= 0 else None for f in t.feature]
            rows.append(pd.DataFrame({"tree": i, "node": np.arange(len(t.feature)), "path": path, "feature": name,
                                      "threshold": cut, "left": t.left, "right": t.right, "depth": t.depth,
                                      "weight": t.weight, "value": self.leaf_values(walk) * self.unit,
                                      "gain": t.gain * self.unit * self.unit}))
        return pd.concat(rows, ignore_index=True)

    def to_json(self) -> str:
        f = self.fit
        return json.dumps({"features": self.features, "cuts": [c.tolist() for c in self.cuts], "unit": self.unit,
                           "fit": [f.kind, f.params, list(f.without), f.seed], "base": int(self.base),
                           "trees": [[x.tolist() for x in t.fields()] for t in self.trees]})

    @staticmethod
    def from_json(s: str) -> "Ensemble":
        d = json.loads(s)
        kind, params, without, seed = d["fit"]
        return Ensemble(d["features"], [np.array(c, float) for c in d["cuts"]], d["unit"], Fit(kind, params, tuple(without), seed),
                        d["base"], [Tree(*map(np.array, t)) for t in d["trees"]])


def _leaf_values(fit: Fit, unit: float, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Node values in whole units; boosting rounds them, so that its residuals stay whole."""
    lam, alpha = fit.penalties(unit)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(weight + lam > 0, _shrunk(total.astype(float), alpha) / (weight + lam), 0.0)
    return v if fit.kind == "forest" else np.rint(v * fit["learning_rate"])


# ---- bins ---------------------------------------------------------------------------------

def coded(x: np.ndarray, cuts: list) -> np.ndarray:
    """Bin codes: the number of cuts below each value."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def _kept(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows in the shared checkpoint folder, in columns: they are read some times for each tree."""
    path = path or _place(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _place(spark) -> str:
    return scratch_path(spark, f"rows-{uuid.uuid4().hex}")


@dataclass
class Binned:
    rows: DataFrame          # h, fold, y (whole units), codes; merged: also n, and y is the sum over the n rows
    features: list
    cuts: list
    unit: float
    n: int                   # of the rows kept


def binned(df: DataFrame, features, target: str, fold_col: str | None = None, merge_over: int | None = None) -> Binned:
    """Rows as bin codes. A feature of at most MAX_BINS values is cut half-way between them, another at
    MAX_BINS - 1 quantiles (a mergeable sketch). NULL or NaN features or targets are an error.

    Of more than ``merge_over`` rows, those of a fold with the same codes are merged into one."""
    features = list(features)
    x = [qcol(f).cast("double") for f in features]
    y = qcol(target).cast("double")
    missing = F.lit(False)
    for c in [*x, y]:
        missing = missing | c.isNull() | F.isnan(c)
    share = [i / MAX_BINS for i in range(1, MAX_BINS)]
    r = df.agg(F.count(F.lit(1)), F.count_if(missing), F.max(F.abs(y)),
               *[F.approx_count_distinct(c, 0.01) for c in x],
               *[F.percentile_approx(c, share, 10_000) for c in x]).first()
    n, bad, top = r[0], r[1], r[2]
    if bad:
        raise ValueError(f"{bad} rows have NULL or NaN features or target; drop or fill them first")
    k = len(features)
    few = [i for i in range(k) if r[3 + i] <= 0.9 * MAX_BINS]       # surely few, whatever the estimate's error
    values = df.agg(*[F.sort_array(F.collect_set(x[i])) for i in few]).first() if few else ()
    cuts = [np.unique(np.array(r[3 + k + i] or [], float)) for i in range(k)]
    for i, v in zip(few, values):
        v = np.array(v, float)
        cuts[i] = (v[1:] + v[:-1]) / 2
    unit = (top or 1.0) / float(1 << _UNIT_BITS)
    names, shared = [f"x{i}" for i in range(k)], df.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        for b in batches:
            code = coded(np.column_stack([b.column(c).to_numpy() for c in names]), shared.value) if b.num_rows else \
                np.zeros((0, k), np.uint8)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(code), [None, pa.py_buffer(code.tobytes())])
            whole = np.rint(b.column("y").to_numpy() / unit).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("fold"), pa.array(whole), flat.cast(pa.binary())],
                                             names=["h", "fold", "y", "codes"])
    fold = qcol(fold_col).cast("int") if fold_col else F.lit(0)
    merge = merge_over is not None and n > merge_over
    h = F.lit(0).cast("long") if merge else F.xxhash64(*[qcol(c) for c in df.columns])
    rows = df.select(h.alias("h"), F.coalesce(fold, F.lit(0)).alias("fold"),
                     y.alias("y"), *[c.alias(n) for c, n in zip(x, names)]).mapInArrow(
        run, "h bigint, fold int, y bigint, codes binary")
    if not merge:
        return Binned(_kept(rows), features, cuts, unit, n)
    rows = _kept(rows.groupBy("h", "fold", "codes").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).select(
        "h", "fold", "y", "codes", "n"))
    return Binned(rows, features, cuts, unit, rows.count())


def _code_rows(column, many: int) -> np.ndarray:
    """(rows, features) of a column of codes, without an object per row."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.zeros((0, many), np.uint8)
    _, ends, data = a.buffers()
    start = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset])
    return np.frombuffer(data, np.uint8, len(a) * many, start).reshape(-1, many)


def _predictions(batch) -> np.ndarray | None:
    """(rows, fits) of the predictions so far, if there are any."""
    if "pred" not in batch.schema.names:
        return None
    return batch.column("pred").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _counts(batch):
    """Of how many rows each row of a batch or table is made."""
    return np.asarray(batch.column("n")).astype(np.int64) if "n" in batch.schema.names else np.ones(batch.num_rows, np.int64)


def _summed(key: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by key; in two parts, so that sums of doubles are exact."""
    low = (1 << 20) - 1
    return (np.bincount(key, v >> 20, size).astype(np.int64) << 20) + np.bincount(key, v & low, size).astype(np.int64)


def _arrays(batch, many: int):
    """(h, fold, y, codes) of an Arrow batch or table of binned rows."""
    col = lambda c: np.asarray(batch.column(c))
    codes = _code_rows(batch.column("codes"), many)
    return col("h").astype(np.int64).view(np.uint64), col("fold"), col("y").astype(np.int64), codes


# ---- growing in one task ------------------------------------------------------------------

def _cell_sums(key: np.ndarray, w: np.ndarray, v: np.ndarray, size: int):
    """Keys in use, ascending, with their sums of w and v: by counting while there are few keys, else by sorting."""
    if size <= 4 * len(key):
        hw = np.bincount(key, w, size)
        at = np.flatnonzero(hw)
        return at, hw[at], (np.bincount(key, v, size) if v.dtype == float else _summed(key, v, size))[at]
    o = np.argsort(key)
    key = key[o]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w[o], first), np.add.reduceat(v[o], first)


def grow(codes: np.ndarray, g: np.ndarray, w: np.ndarray, fit: Fit, tree: int, unit: float,
         path: np.ndarray | None = None, depth: int = 0, weighted: bool = False) -> Tree:
    """The tree, or the subtree from the node ``path`` at ``depth``, of the rows with weight."""
    return grow_together(codes, g[None], w[None], fit, tree, unit, fit.root(tree) if path is None else path, depth, weighted)[0]


def grow_together(codes: np.ndarray, g: np.ndarray, w: np.ndarray, fit: Fit, tree: int, unit: float,
                  path: np.ndarray, depth: int = 0, weighted: bool = False) -> list:
    """A tree for each row of the (trees, rows) gradients and weights, from its node in ``path``; of boosting,
    all have the number ``tree``. Gradients may be ``weighted`` already.

    All features and nodes of a level of all trees are scored together: rows are added up by (node, feature,
    code), in use only, and running sums over these give every split. Nodes that cannot split are not looked at again."""
    many = codes.shape[1]
    lam, alpha = fit.penalties(unit)
    node, row = np.nonzero(w > 0)
    w = w[node, row]
    g = np.broadcast_to(g, (len(path), len(codes)))[node, row] * (1 if weighted else w)
    most = 2 * len(w) + len(path)
    feature, cut, left, right = (np.full(most, -1) for _ in range(4))
    owner, level, weight, total = (np.zeros(most, np.int64) for _ in range(4))
    gains = np.zeros(most)
    n_trees = used = len(path)
    ids, path = np.arange(n_trees), np.asarray(path, np.uint64)
    owner[ids], level[ids] = ids, depth
    weight[ids], total[ids] = _summed(node, w, n_trees), _summed(node, g, n_trees)
    w = w.astype(float)
    if float(np.abs(g.astype(float)).sum()) * many < 1 << 53:       # running sums of doubles are exact
        g = g.astype(float)
    bins = codes.max(axis=0, initial=0).astype(np.int64) + 1
    start = np.cumsum(bins) - bins                                  # a feature's first cell of a node's
    size, of = int(bins.sum()), np.repeat(np.arange(many), bins)
    cells = (codes + start).T[:, row]
    child = max(fit.child, 1)
    while depth < fit.depth:
        # rows of the nodes that may split, numbered anew
        on = weight[ids] >= max(fit.least, 2 * child)
        if not on.all():
            node, ids, path = np.where(on, np.cumsum(on) - 1, -1)[node], ids[on], path[on]
        if len(node) and node.min() < 0:
            stay = np.flatnonzero(node >= 0)
            node, cells, w, g = node[stay], cells[:, stay], w[stay], g[stay]
        if not len(node):
            break
        m = len(ids)
        H, G = weight[ids].astype(float), total[ids].astype(g.dtype)
        may = fit.allowed(path, tree, many)
        some = int(may[0].sum())                                    # the same number at every node
        mine = cells if some == many else cells[np.nonzero(may)[1].reshape(m, some).T[:, node], np.arange(len(node))]
        key, hw, gw = _cell_sums((node * size + mine).ravel(), np.tile(w, some), np.tile(g, some), m * size)
        ends = np.searchsorted(key, np.append((np.arange(m)[:, None] * size + start)[may], m * size))
        per = np.diff(ends)                                         # cells in use of each (node, feature)
        k, Hk = np.repeat(np.arange(m), per.reshape(m, some).sum(axis=1)), np.repeat(np.repeat(H, some), per)
        before = lambda x: np.repeat(np.cumsum(np.repeat(x, some)) - np.repeat(x, some), per)
        # a node's sums come once for each feature that it may split on
        HL = np.cumsum(hw) - before(H)
        HR = Hk - HL
        good = np.flatnonzero((HL >= child) & (HR >= child))
        if not len(good):
            break
        GL = (np.cumsum(gw) - before(G))[good]
        HL, HR, k, cell = HL[good], HR[good], k[good], key[good] - k[good] * size
        a, b = _shrunk(GL.astype(float), alpha), _shrunk((G[k] - GL).astype(float), alpha)
        score = a * a / (HL + lam) + b * b / (HR + lam)
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        best = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(best, np.diff(np.r_[first, len(k)])))
        place = np.full(m, -1)
        place[k[hit][::-1]] = hit[::-1]            # the first best place of each node
        nodes = k[first]
        gain = best - _parent(G[nodes], H[nodes], lam, alpha)
        does = gain > 1e-12 * np.maximum(best, 1.0)
        split = nodes[does]
        if not len(split):
            break
        at, t = place[split], ids[split]
        by = of[cell[at]]
        feature[t], cut[t], gains[t] = by, cell[at] - start[by], gain[does]
        ids = used + np.arange(2 * len(t))
        left[t], right[t] = ids[::2], ids[1::2]
        weight[ids[::2]], total[ids[::2]] = HL[at], GL[at]
        weight[ids[1::2]], total[ids[1::2]] = weight[t] - weight[ids[::2]], total[t] - total[ids[::2]]
        used, depth = used + len(ids), depth + 1
        owner[ids], level[ids] = np.repeat(owner[t], 2), depth
        path = np.stack([_child(path[split], 0), _child(path[split], 1)], axis=1).ravel()
        child_of = np.full(m, -1)
        child_of[split] = 2 * np.arange(len(split))
        last, over = np.zeros(m, np.int64), np.zeros(m, np.int64)
        last[split], over[split] = cell[at], by
        node = child_of[node] + np.where(child_of[node] >= 0, cells[over[node], np.arange(len(node))] > last[node], 0)
        if len(split) < m:
            stay = np.flatnonzero(node >= 0)
            node, cells, w, g = node[stay], cells[:, stay], w[stay], g[stay]
    # nodes were numbered over all trees; within each tree they keep their order
    owner = owner[:used]
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n_trees + 1))
    own = np.empty(used, np.int64)
    own[order] = np.arange(used) - first[owner[order]]
    for side in (left, right):
        side[:used] = np.where(side[:used] >= 0, own[side[:used]], -1)
    return [Tree(*(a[order[x:y]] for a in (feature, cut, left, right, level, weight, total, gains)))
            for x, y in zip(first[:-1], first[1:])]


def _parent(G, H, lam: float, alpha: float) -> np.ndarray:
    s = _shrunk(np.asarray(G, float), alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(H + lam > 0, s * s / (H + lam), 0.0)


def _base(y_sum: int, n: int) -> int:
    return int(np.rint(y_sum / n)) if n else 0


def fit_local(h, fold, y, codes, fit: Fit, unit: float, trees: range | None = None, n=None) -> tuple[int, list]:
    """(base, trees) of a fit on arrays; of a forest, only the numbers ``trees``. Merged rows come with their number ``n``."""
    if fit.kind == "forest":
        out, numbers = [], list(trees or range(int(fit["n_estimators"])))
        step = max(1, _SIDE_BY_SIDE // max(codes.size, 1))
        for some in (numbers[a:a + step] for a in range(0, len(numbers), step)):
            out += grow_together(codes, y[None], np.stack([fit.weights(h, fold, t) for t in some]), fit, 0, unit,
                                 np.concatenate([fit.root(t) for t in some]))
        return 0, out
    inside = ~np.isin(fold, fit.without)
    h, fold, y, codes = h[inside], fold[inside], y[inside], codes[inside]
    n = np.ones(len(y), np.int64) if n is None else n[inside]
    base = _base(int(y.sum()), int(n.sum()))
    now, out = np.full(len(y), base), []
    for t in range(int(fit["n_estimators"])):
        w = fit.weights(h, fold, t)
        made = grow(codes, (y - n * now) * w, n * w, fit, t, unit, weighted=True)
        walk = Walk([made])
        now = now + _leaf_values(fit, unit, walk.total, walk.weight)[walk.ends(codes)[:, 0]].astype(np.int64)
        out.append(made)
    return base, out


# ---- growing on Spark ---------------------------------------------------------------------

class _Growing:
    """A partial tree on the driver."""

    def __init__(self, fit: Fit, tree: int, weight: int, total: int):
        self.fit, self.tree = fit, tree
        self.rows = [[-1, -1, -1, -1, 0, weight, total, 0.0]]
        self.path = [fit.root(tree)[0]]
        self.open = [0] if self._may_split(0) else []

    def _may_split(self, i: int) -> bool:
        return self.rows[i][5] >= self.fit.least and self.rows[i][4] < self.fit.depth

    def split(self, i: int, feature: int, bin_: int, weight: int, total: int, gain: float):
        """Split node i; its left child has ``weight`` and ``total``."""
        row = self.rows[i]
        row[0], row[1], row[2], row[3], row[7] = feature, bin_, len(self.rows), len(self.rows) + 1, gain
        for side, (hw, gw) in enumerate(((weight, total), (row[5] - weight, row[6] - total))):
            self.rows.append([-1, -1, -1, -1, row[4] + 1, hw, gw, 0.0])
            self.path.append(_child(np.array([self.path[i]], np.uint64), side)[0])
            if self._may_split(len(self.rows) - 1):
                self.open.append(len(self.rows) - 1)

    def graft(self, i: int, sub: list):
        """Put the subtree ``sub`` (fields) in the place of node i."""
        base = len(self.rows) - 1
        move = lambda x: i if x == 0 else x + base if x > 0 else -1
        for j, (f, b, le, ri, d, hw, gw, ga) in enumerate(zip(*sub)):
            row = [int(f), int(b), move(int(le)), move(int(ri)), int(d), int(hw), int(gw), float(ga)]
            if j == 0:
                self.rows[i] = row
            else:
                self.rows.append(row)
                self.path.append(np.uint64(0))

    def made(self) -> Tree:
        cols = list(zip(*self.rows))
        return Tree(*(np.array(c, np.int64) for c in cols[:7]), np.array(cols[7], float))


def _placed(batch, many: int, plan: list):
    """Rows of a batch in the open nodes of all trees: yields (numbers of open nodes, row numbers, weights,
    weighted gradients, codes) by slices. ``plan`` has per tree (fit, tree number, its walk, open nodes, number of
    the first of them, column of predictions or None)."""
    h, fold, y, codes = _arrays(batch, many)
    pred, n = _predictions(batch), _counts(batch)
    for fit, tree, walk, open_, first, column in plan:
        w = fit.weights(h, fold, tree)
        number = np.full(len(walk.feature), -1)
        number[open_] = first + np.arange(len(open_))
        at = number[walk.ends(codes)[:, 0]]
        use = np.flatnonzero((at >= 0) & (w > 0))
        g = w * (y if column is None else y - n * pred[:, column])
        yield at[use], use, (w * n)[use], g[use], codes


def _plan(growing: list, nodes: list, columns) -> list:
    """What tasks need of the trees that have open nodes: see ``_placed``."""
    plan, first = [], 0
    for i, (t, open_) in enumerate(zip(growing, nodes)):
        if open_:
            plan.append((t.fit, t.tree, Walk([t.made()]), open_, first, columns[i] if columns else None))
            first += len(open_)
    return plan


def _level(rows: DataFrame, growing: list, nodes: list, columns, many: int, unit: float) -> None:
    """Split the open ``nodes`` of all trees by Spark sums over (node, feature, bin)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((_plan(growing, nodes, columns),
                                           [t.fit.allowed(np.array([t.path[i] for i in open_], np.uint64), t.tree, many)
                                            for t, open_ in zip(growing, nodes) if open_]))

    cells = sum(map(len, nodes)) * many * MAX_BINS

    def batch_of(key, hw, gw):
        return pa.RecordBatch.from_arrays(
            [pa.array((key // (many * MAX_BINS)).astype(np.int32)), pa.array((key // MAX_BINS % many).astype(np.int32)),
             pa.array((key % MAX_BINS).astype(np.int32)), pa.array(hw), pa.array(gw)],
            names=["node", "feature", "bin", "hw", "gw"])

    def sums(batches):
        plan, allowed = shared.value
        few = cells <= _FEW_CELLS          # a task adds up its batches, else each is sent on
        hw, gw = np.zeros((2, cells if few else 0), np.int64)
        for batch in (b for b in batches if b.num_rows):
            keys, ws, gs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (at, use, w, g, codes), p, may in zip(_placed(batch, many, plan), plan, allowed):
                for f in range(many):
                    on = may[at - p[4], f]
                    key, v = (at[on] * many + f) * MAX_BINS + codes[use[on], f], g[on]
                    if few:
                        hw += np.bincount(key, w[on], cells).astype(np.int64)
                        gw += _summed(key, v, cells)
                        continue
                    keys.append(key)
                    ws.append(w[on])
                    gs.append(v)
            if not few:
                key, of = np.unique(np.concatenate(keys), return_inverse=True)
                yield batch_of(key, _summed(of, np.concatenate(ws), len(key)), _summed(of, np.concatenate(gs), len(key)))
        if few:
            key = np.flatnonzero(hw)
            yield batch_of(key, hw[key], gw[key])
    index, info = [], []
    for t, open_ in zip(growing, nodes):
        lam, alpha = t.fit.penalties(unit)
        for i in open_:
            info.append((len(index), t.rows[i][5], t.rows[i][6], lam, alpha, t.fit.child))
            index.append((t, i))
    table = spark.createDataFrame(pd.DataFrame(info, columns=["node", "H", "G", "lam", "alpha", "child"]),
                                  "node int, H bigint, G bigint, lam double, alpha double, child int")
    sent = rows.mapInArrow(sums, "node int, feature int, bin int, hw bigint, gw bigint").repartition("node")
    added = sent.groupBy("node", "feature", "bin").agg(F.sum("hw").alias("hw"), F.sum("gw").alias("gw"))
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    added = added.withColumn("HL", F.sum("hw").over(upto)).withColumn("GL", F.sum("gw").over(upto))
    shrunk = lambda g: F.signum(g) * F.greatest(F.abs(g) - F.col("alpha"), F.lit(0.0))
    side = lambda g, h: (F.when(F.col("alpha") > 0, shrunk(g)).otherwise(g), h + F.col("lam"))
    (a, p), (b, q) = side(F.col("GL").cast("double"), F.col("HL")), side((F.col("G") - F.col("GL")).cast("double"), F.col("H") - F.col("HL"))
    scored = added.join(F.broadcast(table), "node").where("HL >= child and H - HL >= child") \
        .withColumn("score", a * a / p + b * b / q)
    best = scored.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "HL", "GL", "score"),
                                               F.struct("score", -F.col("feature"), -F.col("bin"))).alias("s"))
    found = best.select("node", "s.*").toArrow().to_pydict()
    for node, f, b, hl, gl, s in sorted(zip(*(found[c] for c in ("node", "feature", "bin", "HL", "GL", "score")))):
        t, i = index[node]
        lam, alpha = t.fit.penalties(unit)
        gain = s - float(_parent(t.rows[i][6], t.rows[i][5], lam, alpha))
        if gain > 1e-12 * max(s, 1.0):
            t.split(i, f, b, hl, gl, gain)


def _finish(rows: DataFrame, growing: list, nodes: list, columns, many: int, unit: float) -> None:
    """Send the rows of small open nodes to a task each, which grows the subtree."""
    shared = rows.sparkSession.sparkContext.broadcast(_plan(growing, nodes, columns))

    def send(batches):
        for batch in (b for b in batches if b.num_rows):
            for at, use, w, g, codes in _placed(batch, many, shared.value):
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(many), len(use), [None, pa.py_buffer(codes[use].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w.astype(np.int64)), pa.array(g),
                                                  flat.cast(pa.binary())], names=["node", "w", "g", "codes"])
    index = [(t, i) for t, open_ in zip(growing, nodes) for i in open_]
    about = rows.sparkSession.sparkContext.broadcast([(t.fit, t.tree, int(t.path[i]), t.rows[i][4]) for t, i in index])

    def subtree(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node")[0].as_py()
        fit, tree, path, depth = about.value[node]
        codes = _code_rows(group.column("codes"), many)
        made = grow(codes, group.column("g").to_numpy(), group.column("w").to_numpy(), fit, tree, unit,
                    np.array([path], np.uint64), depth, weighted=True)
        return pa.table([pa.array([node], pa.int32()), *(pa.array([x.tolist()]) for x in made.fields())],
                        names=["node", *Tree.FIELDS])
    ddl = ", ".join(f"{f} array<{'double' if f == 'gain' else 'bigint'}>" for f in Tree.FIELDS)
    found = rows.mapInArrow(send, "node int, w bigint, g bigint, codes binary").groupBy("node").applyInArrow(
        subtree, f"node int, {ddl}").toArrow().to_pydict()
    for node, *sub in sorted(zip(found["node"], *(found[f] for f in Tree.FIELDS))):
        t, i = index[node]
        t.graft(i, sub)


def _roots(rows: DataFrame, trees: list, columns, many: int) -> list:
    """Partial trees of one node each, with the sums of all their rows."""
    shared = rows.sparkSession.sparkContext.broadcast([(f, t, columns[i] if columns else None) for i, (f, t) in enumerate(trees)])

    def sums(batches):
        total = np.zeros((len(shared.value), 2), np.int64)
        for batch in (b for b in batches if b.num_rows):
            h, fold, y, _ = _arrays(batch, many)
            pred, n = _predictions(batch), _counts(batch)
            for i, (fit, tree, column) in enumerate(shared.value):
                w = fit.weights(h, fold, tree)
                total[i] += [(w * n).sum(), ((y if column is None else y - n * pred[:, column]) * w).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1])],
                                         names=["i", "hw", "gw"])
    got = rows.mapInArrow(sums, "i bigint, hw bigint, gw bigint").groupBy("i").agg(F.sum("hw"), F.sum("gw")).collect()
    by = {r[0]: r for r in got}
    return [_Growing(f, t, *(by[i][1:] if i in by else (0, 0))) for i, (f, t) in enumerate(trees)]


def _grown(rows: DataFrame, trees: list, columns, many: int, unit: float, local_rows: int) -> list:
    """The finished trees (fit, number) over all rows."""
    growing = _roots(rows, trees, columns, many)
    while True:
        large = [[i for i in t.open if t.rows[i][5] > local_rows] for t in growing]
        if not any(large):
            break
        for t, now in zip(growing, large):
            t.open = [i for i in t.open if i not in set(now)]
        _level(rows, growing, large, columns, many, unit)
    rest = [list(t.open) for t in growing]
    if any(rest):
        _finish(rows, growing, rest, columns, many, unit)
    return [t.made() for t in growing]


def fit_spread(data: Binned, fits: list, local_rows: int = LOCAL_ROWS) -> list[Ensemble]:
    """All fits together over rows of any number: forests in one go, boosting round by round."""
    many, out = len(data.features), [None] * len(fits)
    model = lambda f, base, trees: Ensemble(data.features, data.cuts, data.unit, f, base, trees)
    forests = [i for i, f in enumerate(fits) if f.kind == "forest"]
    if forests:
        numbered = [(fits[i], t) for i in forests for t in range(int(fits[i]["n_estimators"]))]
        made = iter(_grown(data.rows, numbered, None, many, data.unit, local_rows))
        for i in forests:
            out[i] = model(fits[i], 0, [next(made) for _ in range(int(fits[i]["n_estimators"]))])
    boosted = [i for i, f in enumerate(fits) if f.kind == "boosted"]
    if boosted:
        each = F.col("n") if "n" in data.rows.columns else F.lit(1)
        sums = {r[0]: (r[1], r[2]) for r in data.rows.groupBy("fold").agg(F.sum(each), F.sum("y")).collect()}
        for i in boosted:
            inside = [v for k, v in sums.items() if k not in fits[i].without]
            out[i] = model(fits[i], _base(sum(s for _, s in inside), sum(n for n, _ in inside)), [])
        rows = data.rows.withColumn("pred", F.array(*[F.lit(int(out[i].base)).cast("long") for i in boosted]))
        rounds, path = max(int(fits[i]["n_estimators"]) for i in boosted), None
        for t in range(rounds):
            live = [j for j, i in enumerate(boosted) if t < int(fits[i]["n_estimators"])]
            made = _grown(rows, [(fits[boosted[j]], t) for j in live], live, many, data.unit, local_rows)
            for j, tree in zip(live, made):
                out[boosted[j]].trees.append(tree)
            if t + 1 < rounds:
                before, path = path, _place(rows.sparkSession)
                rows = _kept(_advanced(rows, [(j, fits[boosted[j]], tree) for j, tree in zip(live, made)], many, data.unit), path)
                if before:
                    dropped(rows.sparkSession, before)       # the round before the last is not read again
    return out


def _advanced(rows: DataFrame, made: list, many: int, unit: float) -> DataFrame:
    """Rows with the predictions after one more tree of each boosted fit."""
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            _, _, y, codes = _arrays(batch, many)
            pred = _predictions(batch).copy()
            for j, fit, tree in shared.value:
                walk = Walk([tree])
                pred[:, j] += _leaf_values(fit, unit, walk.total, walk.weight)[walk.ends(codes)[:, 0]].astype(np.int64)
            ends = pa.array(np.arange(len(pred) + 1, dtype=np.int32) * pred.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(pred.ravel()))],
                                             names=batch.schema.names)
    number = "n bigint, " if "n" in rows.columns else ""
    return rows.mapInArrow(run, f"h bigint, fold int, y bigint, codes binary, {number}pred array<bigint>")


# ---- the whole ----------------------------------------------------------------------------

_BLOCK = 25      # trees of a forest that one task grows


def _held(data: Binned, local_rows: int):
    """The binned frame for tasks, if it is bounded by ``local_rows`` rows, else None."""
    if data.n > local_rows:
        return None
    return data.rows.sparkSession.sparkContext.broadcast(_arrays(data.rows.orderBy("h", "y", "fold").toArrow(), len(data.features)))


def _held_merged(data: Binned):
    """The merged frame and the number of each of its rows, for tasks."""
    table = data.rows.toArrow()
    return data.rows.sparkSession.sparkContext.broadcast((*_arrays(table, len(data.features)), _counts(table)))


def _jobs(fits: list) -> list:
    """(fit number, trees of it or None): what one task grows."""
    out = []
    for i, f in enumerate(fits):
        n = int(f["n_estimators"])
        out += [(i, range(a, min(a + _BLOCK, n))) for a in range(0, n, _BLOCK)] if f.kind == "forest" else [(i, None)]
    return out


def _in_tasks(data: Binned, jobs: list, result, schema: str) -> DataFrame:
    """``result(job)`` of every job, one task each: jobs differ in cost, so cores take the next as they are free."""
    def run(batches):
        for b in batches:
            for j in b.column(0).to_pylist():
                yield result(jobs[j])
    return data.rows.sparkSession.range(0, len(jobs), 1, max(len(jobs), 1)).mapInArrow(run, schema)


def fit_all(data: Binned, fits: list, local_rows: int = LOCAL_ROWS, merged_rows: int = MERGED_ROWS) -> list[Ensemble]:
    """All fits; the same models by either way of growing. Rows may be merged if every fit counts them all."""
    if "n" in data.rows.columns:
        if not all(f.whole for f in fits):
            raise ValueError("merged rows serve only boosting that counts every row in every tree")
        held = _held_merged(data) if data.n <= merged_rows else None
    else:
        held = _held(data, local_rows)
    if held is None:
        return fit_spread(data, fits, local_rows)
    unit, jobs = data.unit, _jobs(fits)

    def result(job):
        h, fold, y, codes, *n = held.value
        base, trees = fit_local(h, fold, y, codes, fits[job[0]], unit, job[1], *n)
        return pa.RecordBatch.from_arrays(
            [pa.array([job[0]] * len(trees), pa.int32()),
             pa.array(list(job[1]) if job[1] is not None else list(range(len(trees))), pa.int32()),
             pa.array([base] * len(trees), pa.int64()), *(pa.array([getattr(t, f).tolist() for t in trees]) for f in Tree.FIELDS)],
            names=["fit", "tree", "base", *Tree.FIELDS])
    ddl = ", ".join(f"{f} array<{'double' if f == 'gain' else 'bigint'}>" for f in Tree.FIELDS)
    got = _in_tasks(data, jobs, result, f"fit int, tree int, base bigint, {ddl}").toArrow().sort_by(
        [("fit", "ascending"), ("tree", "ascending")]).to_pydict()
    out = [Ensemble(data.features, data.cuts, unit, f, 0, []) for f in fits]
    for i, base, *fields in zip(got["fit"], got["base"], *(got[f] for f in Tree.FIELDS)):
        out[i].base = base
        out[i].trees.append(Tree(*(np.array(x) for x in fields)))
    return out


def fit_ensemble(df: DataFrame, features, target: str, kind: str, params: dict, seed: int = 42,
                 local_rows: int = LOCAL_ROWS, merged_rows: int = MERGED_ROWS) -> Ensemble:
    """One ensemble on the whole frame."""
    fit = Fit(kind, params, (), seed)
    data = binned(df, features, target, merge_over=local_rows if fit.whole else None)
    return fit_all(data, [fit], local_rows, merged_rows)[0]


OOF = "job int, fold int, role string, label double, prediction double"


def out_of_fold(df: DataFrame, features, target: str, jobs: list[tuple], fold_col: str = "fold",
                seed: int = 42, roles: bool = False, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(job, fold, role, label, prediction): each job (kind, params, fold, *never) fitted without
    its fold and the folds ``never``, and applied to its fold, with ``roles`` also to the
    rows it was fitted on."""
    if not jobs:
        raise ValueError("no jobs")
    data = binned(df, features, target, fold_col)
    fits = [Fit(kind, params, (fold, *never), seed) for kind, params, fold, *never in jobs]
    unit, held = data.unit, _held(data, local_rows)
    own = np.array([j[2] for j in jobs])

    def scored(h, fold, y, codes, part, i: int) -> pa.RecordBatch:
        """Predictions of fit i's trees (of a forest perhaps a part of them) for its rows."""
        rows = np.flatnonzero((fold == own[i]) | (roles & ~np.isin(fold, fits[i].without)))
        at = h[rows].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), i, np.int32)), pa.array(np.where(fold[rows] == own[i], "validation", "train")),
             pa.array(at), pa.array(rows), pa.array(y[rows] * unit), pa.array(part.predict_codes(codes[rows])),
             pa.array(np.full(len(rows), len(part.trees)))], names=["job", "role", "h", "row", "label", "p", "trees"])
    columns = "job int, role string, h bigint, row bigint, label double, p double, trees bigint"
    if held is not None:
        def result(job):
            base, trees = fit_local(*held.value, fits[job[0]], unit, job[1])
            return scored(*held.value, Ensemble([], [], unit, fits[job[0]], base, trees), job[0])
        parts = _in_tasks(data, _jobs(fits), result, columns)
        # blocks of a forest's trees, each by how many they are
        out = parts.groupBy("job", "role", "h", "row").agg(
            F.max("label").alias("label"), (F.sum(F.col("p") * F.col("trees")) / F.sum("trees")).alias("prediction"))
    else:
        models = df.sparkSession.sparkContext.broadcast(fit_spread(data, fits, local_rows))
        many = len(data.features)

        def run(batches):
            for b in batches:
                arrays = _arrays(b, many)
                for i, m in enumerate(models.value):
                    yield scored(*arrays, m, i)
        out = data.rows.mapInArrow(run, columns).withColumnRenamed("p", "prediction")
    fold_of = F.element_at(F.array(*[F.lit(int(f)) for f in own]), F.col("job") + 1)
    return out.select("job", fold_of.alias("fold"), "role", "label", "prediction")


def predict(df: DataFrame, model: Ensemble, out: str = "prediction") -> DataFrame:
    """Predictions by a vectorised walk of all trees over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.column_stack([c.to_numpy(float) for c in cols])))
    return df.withColumn(out, score(*[qcol(f).cast("double") for f in model.features]))


def split_table(model: Ensemble, spark) -> DataFrame:
    """Nodes as a relation: where each stands, how it splits, its weight, value and gain."""
    return spark.createDataFrame(model.node_rows(), "tree int, node int, path string, feature string, threshold double, "
                                 "left int, right int, depth int, weight bigint, value double, gain double")


def gain_importance(splits: DataFrame, features, kind: str) -> DataFrame:
    """Importances that add up to 1, from a split table.

    Boosting: the mean gain of a feature's splits. Forest: its share of each tree's gain, averaged over
    the trees that split. A feature never split on has 0."""
    named = splits.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    used = splits.where("feature is not null")
    if kind == "boosted":
        per = used.groupBy("feature").agg(F.avg("gain").alias("part"))
    else:
        own = used.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        per = own.withColumn("part", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))).groupBy(
            "feature").agg(F.sum("part").alias("part"))
    whole = per.agg(F.sum("part").alias("whole"))            # one row
    return named.join(per, "feature", "left").crossJoin(F.broadcast(whole)).select(
        "feature", F.coalesce(F.col("part") / F.col("whole"), F.lit(0.0)).alias("gain_importance"))


# ---- random search ------------------------------------------------------------------------

def search(df: DataFrame, kind: str, features, target: str, draws: list[dict], fold_col: str = "fold",
           seed: int = 42, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, dict]:
    """Mean and population std of the folds' R² for every draw, and the best draw.

    Draws of forests share trees: how many there are, how deep and from what weight nodes split only cuts
    them, so for each (max_features, min_samples_leaf) one forest per fold serves all its draws."""
    from .evaluate import regression_metrics
    folds = sorted(r[0] for r in df.select(F.col(fold_col).cast("int")).distinct().collect())
    if kind == "forest":
        scored = _shared_forests(df, features, target, draws, folds, fold_col, seed, local_rows)
    else:
        jobs = [(kind, d, f) for d in draws for f in folds]
        scored = out_of_fold(df, features, target, jobs, fold_col, seed, local_rows=local_rows).withColumn(
            "draw", F.floor(F.col("job") / len(folds)).cast("int"))
    met = regression_metrics(scored, "label", "prediction", keys=("draw", "fold"))
    names = df.sparkSession.createDataFrame([(i, json.dumps(d, sort_keys=True)) for i, d in enumerate(draws)],
                                            "draw int, params string")
    table = cut_lineage(met.groupBy("draw").agg(
        F.avg("R2").alias("cv_R2_mean"), F.stddev_pop("R2").alias("cv_R2_std")).join(names, "draw")
        .select("draw", "params", "cv_R2_mean", "cv_R2_std"))
    top = table.orderBy(F.col("cv_R2_mean").desc(), "draw").first()
    return table, draws[top["draw"]]


def _shared_forests(df, features, target, draws, folds, fold_col, seed, local_rows) -> DataFrame:
    """(draw, fold, label, prediction) of all draws of a forest search."""
    data = binned(df, features, target, fold_col)
    single = [Fit("forest", d, (), seed) for d in draws]
    groups: dict = {}
    for i, f in enumerate(single):
        groups.setdefault((_share(f["max_features"], len(data.features)), f.child), []).append(i)
    fits, serves = [], []
    for (share, child), mine in groups.items():
        widest = {"n_estimators": max(int(single[i]["n_estimators"]) for i in mine), "min_samples_leaf": child,
                  "max_features": single[mine[0]]["max_features"], "min_samples_split": min(single[i].least for i in mine),
                  "max_depth": None if any(single[i]["max_depth"] is None for i in mine) else max(single[i].depth for i in mine)}
        for f in folds:
            fits.append(Fit("forest", widest, (f,), seed))
            serves.append((f, [(i, int(single[i]["n_estimators"]), single[i].depth, single[i].least) for i in mine]))
    unit = data.unit
    held = _held(data, local_rows)

    def scored(h, fold, y, codes, trees: list, numbers: range, i: int) -> pa.RecordBatch:
        """Sums over the trees that each draw has, cut as it wants them."""
        f, wanted = serves[i]
        rows = np.flatnonzero(fold == f)
        walk, out = Walk(trees), []
        value = _leaf_values(fits[i], unit, walk.total, walk.weight)
        cache: dict = {}
        for draw, n, depth, least in wanted:
            use = max(0, min(n, numbers.stop) - numbers.start)
            if not use:
                continue
            if (depth, least) not in cache:
                cache[depth, least] = value[walk.ends(codes[rows], depth, least)]
            out.append((draw, cache[depth, least][:, :use].sum(axis=1) * (unit / n)))
        m = len(rows)
        col = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(col([np.full(m, d) for d, _ in out]).astype(np.int32)), pa.array(np.full(m * len(out), f, np.int32)),
             pa.array(np.tile(h[rows].view(np.int64), len(out))), pa.array(np.tile(rows, len(out)).astype(np.int64)),
             pa.array(np.tile(y[rows] * unit, len(out))), pa.array(col([p for _, p in out]))],
            names=["draw", "fold", "h", "row", "label", "p"])
    schema = "draw int, fold int, h bigint, row bigint, label double, p double"
    if held is not None:
        def result(job):
            return scored(*held.value, fit_local(*held.value, fits[job[0]], unit, job[1])[1], job[1], job[0])
        parts = _in_tasks(data, _jobs(fits), result, schema)
        return parts.groupBy("draw", "fold", "h", "row").agg(F.max("label").alias("label"), F.sum("p").alias("prediction"))
    models = df.sparkSession.sparkContext.broadcast([m.trees for m in fit_spread(data, fits, local_rows)])
    many = len(data.features)

    def run(batches):
        for b in batches:
            arrays = _arrays(b, many)
            for i, t in enumerate(models.value):
                yield scored(*arrays, t, range(len(t)), i)
    return data.rows.mapInArrow(run, schema).withColumnRenamed("p", "prediction")
