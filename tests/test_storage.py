import os

import pytest

from quern.plans import storage


class OnCluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(OnCluster)


def test_stashed_tables_can_go_early(spark):
    one = storage.stash(spark.range(5).toDF("x"), "one")
    two = storage.stash(one.selectExpr("x + 1 AS x"), "two", drop=(one,))
    assert sorted(r["x"] for r in two.collect()) == [1, 2, 3, 4, 5]
    assert not os.path.exists(one._quern_path.removeprefix("file://")) and os.path.exists(two._quern_path.removeprefix("file://"))
    storage.unstash(spark.range(1))


def test_global_rank_of_ties_and_of_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).withColumn("v", F.lit(7))
    got = storage.global_rank(rows, F.asc("v"), F.asc("id")).collect()
    assert all(r["rank"] == r["id"] + 1 for r in got) and len(got) == 1000
    assert storage.global_rank(rows.limit(0), F.asc("v")).count() == 0
