"""Interpolation edge rules, profiles, encoding, splits."""

import pytest
from pyspark.sql import functions as F

from diurna.operators import clean, encode, profile, split


def test_interpolation_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)], "k int, v double")
    out = [r["v"] for r in clean.interpolate_linear(df, "v", "k").orderBy("k").collect()]
    assert out == [None, 1.0, 2.0, 3.0, 3.0]


def test_sentinel_interpolation_per_series(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.0), ("a", 3, 0.7), ("b", 1, 0.0), ("b", 2, 0.4)],
                               "s string, k int, hum double")
    out = {(r["s"], r["k"]): r["hum"] for r in clean.interpolate_linear(df, "hum", "k", keys=("s",), sentinel=0.0).collect()}
    assert out[("a", 2)] == pytest.approx(0.6) and out[("b", 1)] is None


def test_describe_matches_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 5.0, 9.0, 11.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.describe(df, ["x"]).first()
    s = pd.Series(vals).describe()
    for a, b in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                 ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
        assert r[a] == pytest.approx(s[b])


def test_iqr_and_box(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, x double")
    r = profile.iqr_outliers(df, ["x"]).first()
    assert r["outlier_count"] == 1
    b = profile.box_stats(df, "g", "x").first()
    assert b["whisker_high"] == 5.0 and b["n_fliers"] == 1


def test_split_profile_missing_side(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "c string, split string")
    r = {x["c"]: (x["train"], x["test"]) for x in profile.split_profile(df, "c").collect()}
    assert r == {"a": (1, 1), "b": (None, 1)}


def test_one_hot_drops_smallest_and_keeps_test_only_level(spark):
    tr = spark.createDataFrame([(1.0,), (2.0,)], "w double")
    te = spark.createDataFrame([(26.0,), (1.0,)], "w double")
    lv = encode.union_levels([tr, te], ["w"])
    out, names = encode.one_hot(te, ["w"], level_map=lv)
    assert names == ["w_2.0", "w_26.0"]
    assert [r["w_26.0"] for r in out.collect()] == [1.0, 0.0]


def test_hash_split_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = split.hash_split(df, "k").where("split = 'test'").count()
    b = split.hash_split(df.repartition(7), "k").where("split = 'test'").count()
    assert a == b and 150 < a < 250


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 3, 7]], "g string, x double")
    k = profile.gaussian_kde(df, "x", "g", grid_size=400).orderBy("point").collect()
    step = k[1]["grid_x"] - k[0]["grid_x"]
    assert sum(r["density"] for r in k) * step == pytest.approx(1.0, abs=0.01)


def test_bucketed_interpolation_equals_single_window(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for s in ("a", "b"):
        for k in range(300):
            rows.append((s, k, None if rnd.random() < 0.4 else float(rnd.randint(0, 100))))
    rows += [("c", k, None) for k in range(10)]          # a series with no value at all
    df = spark.createDataFrame(rows, "s string, k int, v double")
    one = clean.interpolate_linear(df, "v", "k", keys=("s",), out_col="f")
    many = clean.interpolate_linear(df, "v", "k", keys=("s",), out_col="f", bucket=(F.col("k") / 7).cast("int"))
    a = {(r["s"], r["k"]): r["f"] for r in one.collect()}
    b = {(r["s"], r["k"]): r["f"] for r in many.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert (a[key] is None and b[key] is None) or a[key] == pytest.approx(b[key], abs=1e-9)


def test_exact_quantile_matches_numpy(spark):
    import numpy as np
    x = np.random.default_rng(5).normal(size=20000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for p in (0.05, 0.5, 0.75):
        assert profile.exact_quantile(df, "x", p) == pytest.approx(
            float(np.quantile(x, p)), abs=1e-12)


def test_grouped_exact_quantiles_with_ties_and_refinement(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000)
    g = rng.integers(0, 3, size=20000)
    x[g == 2] = np.round(x[g == 2])   # heavy ties in one group
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    probs = [0.0, 0.05, 0.5, 0.75, 1.0]
    res = {(r["g"], r["p"]): r["value"]
           for r in profile.exact_quantiles(df, "x", probs, keys=["g"]).collect()}
    # a coarse sketch misses ranks and leaves large brackets, which are cut again
    for kw in (dict(accuracy=100, few=10, most=60), dict(accuracy=5000, few=10, most=3)):
        again = profile.exact_quantiles(df, "x", probs, keys=["g"], **kw).collect()
        assert {(r["g"], r["p"]): r["value"] for r in again} == res
    for k in range(3):
        for p in probs:
            assert res[(k, p)] == pytest.approx(float(np.quantile(x[g == k], p)), abs=1e-12)


def test_quantiles_whatever_the_range(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = 10.0 ** rng.uniform(-300, 300, 15000) * rng.choice([-1, 1], 15000)
    rows = [(None if i % 7 == 0 else float(v), float(i % 3), None if i % 2 else "g") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, k string")
    keep = np.array([i % 7 != 0 for i in range(15000)])
    got = {(r["column"], r["p"]): r["value"] for r in profile.wide_quantiles(df, ["x", "y"], [0.25, 0.5, 0.999]).collect()}
    for p in (0.25, 0.5, 0.999):
        s = np.sort(x[keep])
        at = p * (len(s) - 1)
        a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
        assert got[("x", p)] == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12)
        assert got[("y", p)] == np.quantile([float(i % 3) for i in range(15000)], p)
    by = {(r["k"], r["p"]): r["value"] for r in profile.exact_quantiles(df, "y", [0.5], keys=["k"]).collect()}
    assert by == {("g", 0.5): 1.0, (None, 0.5): 1.0}
    alone = df.select(F.lit(None).cast("double").alias("n"), "y")
    assert [r["column"] for r in profile.wide_quantiles(alone, ["n", "y"], [0.5]).collect()] == ["y"]


def test_student_t_p_values():
    import numpy as np
    # reference values of the two-sided t test
    got = profile.student_t_two_sided_p(np.array([2.0, 1.0, 3.5, 0.0, -2.0]), np.array([10.0, 5.0, 30.0, 7.0, 10.0]))
    want = [0.07338803, 0.36321747, 0.00147681, 1.0, 0.07338803]   # checked by numeric integration
    assert np.allclose(got, want, atol=2e-7)


def test_exact_size_split(spark):
    df = spark.range(731).withColumnRenamed("id", "k")
    s = split.hash_split(df, "k", 0.2, exact_size=True)
    assert s.where("split = 'test'").count() == 147 and s.count() == 731


def test_exact_size_folds(spark):
    df = spark.range(362).withColumnRenamed("id", "k")
    sizes = sorted((r["fold"], r["n"]) for r in split.kfold(df, "k", 5, exact_sizes=True).groupBy("fold").count()
                   .withColumnRenamed("count", "n").collect())
    assert [n for _, n in sizes] == [73, 73, 72, 72, 72]


def test_exact_sizes_need_a_key_of_one_row(spark):
    df = spark.range(100).selectExpr("id % 10 AS k")
    with pytest.raises(ValueError):
        split.hash_split(df, "k", 0.25, exact_size=True)
    with pytest.raises(ValueError):
        split.kfold(df, "k", 3, exact_sizes=True)


def test_quantiles_of_many_groups_and_ties(spark):
    # more groups than any list on the driver should hold, and one value of a third of all rows
    df = spark.range(120_000).selectExpr("id % 40000 AS g", "CAST(id DIV 40000 AS double) AS x")
    box = profile.box_stats(df, "g", "x")
    assert box.count() == 40_000
    assert box.where("q1 <> 0.5 OR median <> 1.0 OR q3 <> 1.5").count() == 0
    tied = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7.0D, CAST(id AS double)) AS x")
    import numpy as np
    x = np.array([7.0 if i % 3 == 0 else float(i) for i in range(30_000)])
    for p in (0.1, 0.33, 0.34, 0.9):
        assert profile.exact_quantile(tied, "x", p) == pytest.approx(float(np.quantile(x, p)), abs=1e-9)
    wide = spark.createDataFrame([(v,) for v in (-1.7e308, -1.0, 5e-324, 1.7e308)], "x double")
    assert profile.exact_quantile(wide, "x", 1 / 3) == -1.0
    assert profile.exact_quantile(wide.where("false"), "x", 0.5) is None


def test_kde_is_one_rule_at_every_size(spark):
    import numpy as np
    small = spark.range(50).selectExpr("1 AS g", "CAST(id AS double) AS x")
    for n, df in ((50, small), (4000, spark.range(4000).selectExpr("1 AS g", "CAST(id AS double) / 80 AS x"))):
        x = np.arange(50.0) if n == 50 else np.arange(4000) / 80
        bw = x.std(ddof=1) * n ** -0.2
        rows = profile.gaussian_kde(df, "x", "g", grid_size=5).orderBy("point").collect()
        for r in rows:
            want = np.exp(-0.5 * ((r["grid_x"] - x) / bw) ** 2).sum() / (n * bw * np.sqrt(2 * np.pi))
            assert r["density"] == pytest.approx(want, rel=1e-9)


def test_many_levels(spark):
    from diurna.operators import encode
    df = spark.range(1500).selectExpr("CAST(id AS int) AS c")
    out, names = encode.one_hot(df, ["c"])
    assert len(names) == 1499 and len(out.columns) == 1499


def test_global_row_number(spark):
    from pyspark.sql import functions as F
    from diurna.operators.ranking import global_row_number
    df = spark.range(5000).selectExpr("(id * 7919) % 5003 AS k").repartition(7)
    got = [r["n"] for r in global_row_number(df, [F.col("k").desc()], "n").orderBy(F.col("k").desc()).collect()]
    assert got == list(range(5000))
