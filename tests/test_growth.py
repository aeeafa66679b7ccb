"""Work of one task stays bounded as tables grow."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.functions.hashing import hash_int
from diurna.operators import anomaly as N
from diurna.operators import profile, trees
from diurna.plans import q_ml, sql_forest
from diurna.plans.frames import SQL_LINE_FRAME
from diurna.session import checkpoint_dir


def test_forest_pool_is_cut_before_it_is_ranked(spark):
    """the rows that meet in one task are about as many as the pool holds, of repeated and missing keys too."""
    d = spark.range(60_000).select((F.col("id") % 2).alias("__period"), F.col("id").alias("__key"),
                                   hash_int("id", "pool|1").alias("__h"))
    near = N.pool_candidates(d, 100).toPandas()
    assert len(near) <= 220
    for p, of in d.toPandas().groupby("__period"):
        want = of.sort_values(["__h", "__key"]).head(100)["__key"]
        assert set(want) <= set(near[near["__period"] == p]["__key"])
    odd = spark.range(0, 9_000, 1, 3).select(F.lit(None).cast("int").alias("__period"),
                                             F.when(F.col("id") % 3 > 0, F.lit(5)).alias("__key"))
    odd = odd.withColumn("__h", hash_int("__key", "pool|1"))
    assert N.pool_candidates(odd, 100).groupBy("__key").count().collect() == [(None, 300)]
    assert {tuple(r) for r in N.pool_candidates(odd, 3_500).groupBy("__key").count().collect()} == {(None, 3_000), (5, 6_000)}


def _groups(spark):
    rows = spark.range(0, 4_000, 1, 4).select(
        F.when(F.col("id") % 7 < 4, "a").when(F.col("id") % 7 == 4, "b").when(F.col("id") % 7 == 5, "c").alias("g"),
        (F.col("id") * 7919 % 4_001 / 10).alias("v"))
    return rows, rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def test_rows_of_large_groups_meet_their_group_by_broadcast(spark):
    """a row per group is the same whether all groups are broadcast, some or none are large."""
    rows, table = _groups(spark)
    n = {r["g"]: r["n"] for r in table.collect()}
    for hot in (10, 2, 1):
        got = profile.with_groups(rows, table, ["g"], "n", hot)
        assert got.columns == ["g", "v", "n"]
        assert {(r["g"], r["n"]): r["count"] for r in got.groupBy("g", "n").count().collect()} == {(g, k): k for g, k in n.items()}
    few = profile.with_groups(rows, table, ["g"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few


def test_box_queries_do_not_sort_groups(spark):
    """the rows of a group are not brought into one task."""
    rows, _ = _groups(spark)
    plan = profile.box_fliers(rows, "g", "v", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    x = {g: p["v"].to_numpy() for g, p in rows.where("g IS NOT NULL").toPandas().groupby("g")}
    for r in profile.box_stats(rows, "g", "v", 0.1).collect():
        q = np.quantile(x[r["g"]], [0.25, 0.5, 0.75])
        assert np.allclose(q, [r["q1"], r["median"], r["q3"]]) and r["n"] == len(x[r["g"]])
        step = 0.1 * (q[2] - q[0])
        assert r["n_fliers"] == ((x[r["g"]] < q[0] - step) | (x[r["g"]] > q[2] + step)).sum()


def test_the_daily_frame_reads_the_lines_once(spark, tmp_path):
    """What follows reads the days, not the lines again."""
    spark.range(400).select(
        F.expr("date_add(DATE '1999-11-01', CAST(id % 120 AS INT))").alias("l_shipdate"), (F.col("id") % 50 + 1.0).alias("l_quantity"),
        *[(F.col("id") % 7 / 100).alias(f"l_{c}") for c in ("discount", "tax", "extendedprice")],
        F.lit("R").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = q_ml._daily(spark, str(tmp_path))
    assert "FileScan" not in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 120 and d.agg(F.sum("cnt")).first()[0] == 400


def test_level_sums_are_whole_and_kept_per_task(spark, monkeypatch):
    """Sums of a level are exact, and the trees are the same whether tasks keep them or send each batch's."""
    rng = np.random.default_rng(0)
    key, v = rng.integers(0, 3, 2_000), rng.integers(-(1 << 60), 1 << 60, 2_000) >> 8
    assert trees._summed(key, v, 4).tolist() == [sum(int(x) for x in v[key == k]) for k in range(4)]
    df = spark.range(0, 300, 1, 3).select((F.col("id") * 37 % 19).alias("a"), (F.col("id") * 11 % 23).alias("b"),
                                          (F.col("id") * 53 % 101).alias("y"))
    data = trees.binned(df, ["a", "b"], "y")
    assert "FileScan parquet" in data.rows._jdf.queryExecution().executedPlan().toString()
    codes = data.rows.select("codes").toArrow().column("codes")
    assert (trees._code_rows(codes, 2) == np.array([list(c) for c in codes.to_pylist()])).all()
    fits = [trees.Fit("boosted", {"n_estimators": 2, "max_depth": 3}), trees.Fit("forest", {"n_estimators": 2, "max_depth": 3})]
    made = []
    for few in (trees._FEW_CELLS, 0):
        monkeypatch.setattr(trees, "_FEW_CELLS", few)
        made.append([m.to_json() for m in trees.fit_all(data, fits, 0)])
    assert made[0] == made[1]


def test_trees_of_a_block_are_grown_side_by_side(monkeypatch):
    """A block's trees take the levels of its deepest one together, and are those grown one by one."""
    rng = np.random.default_rng(1)
    codes, y, h = rng.integers(0, 9, (300, 4)).astype(np.uint8), rng.integers(0, 1 << 30, 300), rng.integers(0, 1 << 60, 300).astype(np.uint64)
    fold, fit = np.arange(300) % 5, trees.Fit("forest", {"n_estimators": 12, "max_features": 0.5, "min_samples_leaf": 2}, (0,))
    alone = [trees.grow(codes, y, fit.weights(h, fold, t), fit, t, 1.0) for t in range(12)]
    levels, allowed = [], trees.Fit.allowed
    monkeypatch.setattr(trees.Fit, "allowed", lambda *a: levels.append(1) or allowed(*a))
    _, made = trees.fit_local(h, fold, y, codes, fit, 1.0)
    assert [[x.tolist() for x in t.fields()] for t in made] == [[x.tolist() for x in t.fields()] for t in alone]
    assert len(levels) <= max(t.depth.max() for t in alone) + 1
    for size in (1 << 10, 1 << 40):                   # counted, and sorted
        key, w, v = trees._cell_sums(codes[:, 0].astype(np.int64), np.ones(300), y, size)
        assert key.tolist() == list(range(9)) and v.tolist() == [y[codes[:, 0] == k].sum() for k in key]
    small = trees.grow(codes, y >> 20, np.ones(300, np.int64), fit, 0, 1.0)
    large = trees.grow(codes, y >> 20 << 40, np.ones(300, np.int64), fit, 0, 1.0)      # beyond what doubles add up exactly
    assert (large.feature == small.feature).all() and (large.bin == small.bin).all() and (large.total == small.total << 40).all()


def _lines(spark, folder):
    """A lineitem table of 900 rows, a third of them twice, and its path."""
    spark.range(0, 900, 1, 3).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
        (F.col("id") * 31 % 200).alias("l_partkey"), (F.col("id") * 17 % 10).alias("l_suppkey"),
        (F.col("id") * 7919 % 23 + 1.0).alias("l_quantity"), (F.col("id") * 13 % 11 / 100).alias("l_discount"),
        (F.col("id") * 5 % 9 / 100).alias("l_tax"), (900.0 + F.col("id") * 104_729 % 9_001).alias("l_extendedprice"),
        F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.expr("CAST(date_add(DATE '1999-01-03', CAST(id * 37 % 700 AS INT)) AS TIMESTAMP)").alias("l_shipdate")).withColumn(
        "__n", F.explode(F.sequence(F.lit(1), F.when(F.col("l_orderkey") % 3 == 0, 2).otherwise(1)))).drop("__n").write.parquet(
        f"{folder}/lineitem.parquet")
    return str(folder)


def test_line_splits_are_all_rounds_of_the_full_depth(spark, tmp_path):
    """300 rounds of depth 6 without bounds on leaves, the first of them as SQL grows them."""
    base = _lines(spark, tmp_path)
    got = [tuple(r) for r in q_ml.q_boosted_line_splits(spark, base).collect()]
    assert {r[0] for r in got} == set(range(300)) and max(len(r[1]) for r in got) == 6 and min(r[4] for r in got) < 5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{base}/lineitem.parquet/*.parquet')")
    some = sql_forest.boosted_rounds("tr", q_ml.LINE_FULL.features, "revenue", 4, 6, 0.3, 1.0, 0.0, 1)
    rows = con.execute(f"""WITH RECURSIVE d AS MATERIALIZED ({SQL_LINE_FRAME}), tr AS MATERIALIZED (SELECT * FROM d WHERE split = 'train'),
        {some} SELECT tree, path, feature, threshold, weight, value FROM splits""").fetchall()
    want = {r[:2]: r[2:] for r in rows}
    first = {r[:2]: r[2:] for r in got if r[0] < 4}
    assert len(want) == len(rows) and first.keys() == want.keys()
    for at, (feature, threshold, weight, value) in want.items():
        f, t, w, v = first[at]
        assert (f, w) == (feature, weight) and abs(v - value) < 1e-3 and (feature is None or abs(t - threshold) < 1e-4)


def test_merged_rows_are_boosted_to_the_same_trees(spark):
    """a row per combination of codes, in one task or on Spark, gives the trees of all rows; each round's rows replace the last's."""
    df = spark.range(0, 3_000, 1, 4).select((F.col("id") % 13).alias("a"), (F.col("id") * 7919 % 11).alias("b"),
                                            (F.col("id") * 104_729 % 9_973 / 7).alias("y"), (F.col("id") % 3).alias("fold"))
    params = {"n_estimators": 3, "max_depth": 4, "reg_alpha": 3.0, "min_child_weight": 5}
    node = ["tree", "path", "feature", "threshold", "weight", "value", "gain"]       # their order differs by the way grown
    shape = lambda m: sorted(map(repr, m.node_rows()[node].itertuples(index=False)))
    one = lambda *bounds: shape(trees.fit_ensemble(df, ["a", "b"], "y", "boosted", params, 42, *bounds))
    want = one(3_000)
    kept = lambda: {f for f in os.listdir(checkpoint_dir(spark)) if f.startswith("rows-")}
    before = kept()
    assert one(2_999) == want and len(kept() - before) == 1
    before = kept()
    assert one(100, 0) == want and len(kept() - before) == 2
    assert one(0, 0) == want
    merged, rows = (trees.binned(df, ["a", "b"], "y", "fold", n) for n in (0, None))
    assert merged.n == merged.rows.count() == 143 * 3 and merged.rows.agg(F.sum("n")).first()[0] == rows.n == 3_000
    fits = [trees.Fit("boosted", params, (0,)), trees.Fit("boosted", {**params, "n_estimators": 2}, (1,))]
    made = [list(map(shape, trees.fit_all(*how))) for how in ((rows, fits), (merged, fits), (merged, fits, 0, 0))]
    assert made[0] == made[1] == made[2]
    with pytest.raises(ValueError, match="merged"):
        trees.fit_all(merged, [trees.Fit("boosted", {"subsample": 0.5})])


def test_worst_errors_are_flagged_from_the_written_days(spark, tmp_path, monkeypatch):
    """the anomalies of the years are found without another read of the lines."""
    spark.range(3_000).select(
        F.expr("date_add(DATE '1999-11-01', CAST(id % 120 AS INT))").alias("l_shipdate"), (F.col("id") * 7 % 50 + 1.0).alias("l_quantity"),
        *[(F.col("id") % 7 / 100).alias(f"l_{c}") for c in ("discount", "tax", "extendedprice")],
        F.lit("R").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    d, spec, seen = q_ml._daily(spark, str(tmp_path)), q_ml.M.ModelSpec("ols", "ols", ("quantity",)), []
    monkeypatch.setattr(q_ml, "_winner", lambda *a: (d, spec, q_ml.M.fit(spec, q_ml.S.part(d, "train"), "cnt")))
    found = q_ml.N.detect_by_period
    monkeypatch.setattr(q_ml.N, "detect_by_period", lambda df, *a, **k: seen.append(df) or found(df, *a, **k))
    rows = q_ml.q_winner_worst_errors(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and len(seen) == 1
    assert "FileScan" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() == 120
