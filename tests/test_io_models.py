"""Sources/sinks, model persistence, the severity rule against a per-group pandas double."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna.operators import models as M
from diurna.operators.rollup import daily_rollup
from diurna.plans.daily import EVENTS_SPEC, hourly_log
from diurna.session import scratch_path
from diurna.sources.tables import read_csv, read_table, write_table

SMALL = "/root/testdata/sf0.001"


def test_bom_csv_with_non_latin_text(spark):
    d = tempfile.mkdtemp(prefix="diurna-test-")
    p = os.path.join(d, "labels.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("dteday,top_cause,cnt\n2012-10-29,풍속,22\n2011-01-27,습도,431\n")
    df = read_csv(spark, p)
    assert df.columns == ["dteday", "top_cause", "cnt"]
    assert sorted(r["top_cause"] for r in df.collect()) == ["습도", "풍속"]


def test_sink_refuses_its_input(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        write_table(df, "/tmp/x/in.parquet", source_paths=["file:/tmp/x/in.parquet"])


def test_partitioned_sink_prunes(spark):
    p = scratch_path(spark, "test-years")
    df = spark.createDataFrame([(2015, 1), (2016, 2), (2017, 3)], "year int, v int")
    write_table(df, p, partition_by=("year",))
    back = spark.read.parquet(p).where("year = 2016")
    assert [r["v"] for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_model_persistence(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 1.0) for i in range(40)], "a double, b double, y double")
    ols = M.fit_ols(df, ["a", "b"], "y")
    back = M.OLSModel.from_json(ols.to_json())
    assert back.intercept == pytest.approx(1.0) and back.coef[0] == pytest.approx(2.0)
    fm = M.fit(M.ModelSpec("f", "forest", ("a", "b"), {"numTrees": 5, "maxDepth": 3}, "ml"), df, "y")
    p = scratch_path(spark, "test-forest-model")
    from diurna.sources.tables import load_model, save_model
    from pyspark.ml.regression import RandomForestRegressionModel
    save_model(fm.model, p)
    m2 = load_model(RandomForestRegressionModel, p)
    assert m2.getNumTrees == 5


def test_severity_native_equals_pandas_double(spark):
    """The per-day pandas rule (run via applyInPandas) and the native window plan agree."""
    h = hourly_log(read_table(spark, SMALL, "events"))

    def per_day(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values(["hour", "timestamp"]).reset_index(drop=True)
        worst = g["code"].max()
        hit = g["code"].eq(worst)
        # a run starts at a worst row whose predecessor is not a worst row one hour earlier
        starts = hit & ~(hit.shift(1, fill_value=False) & g["hour"].diff().eq(1))
        longest = int(hit.groupby(starts.cumsum()).sum().max()) if hit.any() else 0
        counts = g["code"].value_counts()
        mode = counts[counts.eq(counts.max())].index.max()
        sev = worst if longest >= 4 else mode
        return pd.DataFrame({"series": [g["series"].iloc[0]], "date": [g["date"].iloc[0]], "code": [float(sev)]})

    hh = h.withColumn("date", F.to_date("timestamp")).withColumn("hour", F.hour("timestamp"))
    double = hh.groupBy("series", "date").applyInPandas(per_day, "series int, date date, code double")
    native = daily_rollup(h, EVENTS_SPEC).select("series", "date", "code")
    diff = native.exceptAll(double).count() + double.exceptAll(native).count()
    assert diff == 0 and native.count() > 0


def test_diagnostics_are_never_features():
    import pytest

    from diurna.operators import encode
    with pytest.raises(ValueError):
        encode.FeatureSet("tree", ("a", "n_hours"), diagnostics=("n_hours",))


def test_label_of_an_unknown_code(spark):
    from diurna.functions.scalar import label_of, sentinel_to_null
    df = spark.createDataFrame([(1,), (26,), (None,)], "c int")
    got = [r["l"] for r in df.select(label_of("c", {1: "clear"}).alias("l")).collect()]
    assert got == ["clear", "26", None]
    assert df.where(sentinel_to_null("c", 26).isNull()).count() == 2
