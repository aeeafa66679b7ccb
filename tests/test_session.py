"""Session helpers: shared checkpoint folder and lineage cuts."""

import pytest

from diurna.session import checkpoint_dir, cut_lineage


def test_checkpoint_dir_is_reused(spark):
    a = checkpoint_dir(spark)
    assert a and checkpoint_dir(spark) == a
    assert spark.conf.get("spark.checkpoint.dir") in (a, a.replace("file:", ""), "file:" + a)


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(1000).selectExpr("id", "id * 2 AS v")
    c = cut_lineage(df)
    assert c.count() == 1000 and c.agg({"v": "sum"}).first()[0] == 999000


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        checkpoint_dir(Session())
