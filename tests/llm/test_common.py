"""Shared folders, hot keys, names."""

import glob


import pytest
from pyspark.sql import functions as F

from loomlog.llm import common


def test_shared_folders_are_cleared(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    df = common.materialise(spark.range(5), "cleared")
    assert df.count() == 5 and glob.glob(f"{base}/cleared-*")
    assert common.clear_shared(spark) >= 1
    assert not glob.glob(f"{base}/cleared-*") and common.clear_shared(spark) == 0


def test_attach_equals_a_join(spark, monkeypatch):
    rows = spark.range(500).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    want = sorted(map(tuple, rows.join(groups, "k").collect()))
    for limit in (1, 50, 10_000):
        monkeypatch.setattr(common, "hot_limit", lambda n, limit=limit: limit)
        assert sorted(map(tuple, common.attach(rows, groups, "k", "n", 500).collect())) == want


def test_hot_keys_are_few():
    for n in (0, 10, 10**6, 10**9, 10**12):
        assert n / common.hot_limit(n) <= 4096


def test_row_ids_are_stable_and_names_come_back(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    a = {tuple(r) for r in common.with_row_id(df).collect()}
    assert a == {tuple(r) for r in common.with_row_id(df).orderBy("id").collect()} and len({x[1] for x in a}) == 1000
    odd = df.select("id", F.lit(1).alias("a.b"), F.lit(2).alias("c`d"))
    assert common.renamed(odd, lambda x: x.where("id = 3")).columns == odd.columns


def test_row_ids_do_not_depend_on_splits(spark, tmp_path):
    path = f"file://{tmp_path}/odd name/t.parquet"
    spark.range(1000).select("id", F.lit(1).alias("__file")).repartition(7).write.parquet(path)
    conf = {"spark.sql.leafNodeDefaultParallelism": ("1", "8"), "spark.sql.files.maxPartitionBytes": ("128m", "512"), "spark.sql.files.openCostInBytes": ("4m", "1")}
    found = []
    for k in range(2):
        for name, values in conf.items():
            spark.conf.set(name, values[k])
        try:
            df = common.with_row_id(spark.read.parquet(path).where("id >= 0"))
            found.append((df.rdd.getNumPartitions(), {tuple(r) for r in df.collect()}))
        finally:
            for name in conf:
                spark.conf.unset(name)
    assert found[0][0] < found[1][0] and found[0][1] == found[1][1] and len({r[-1] for r in found[0][1]}) == 1000


def test_row_ids_of_other_tables_are_written_down(spark):
    df = common.with_row_id(spark.range(50).repartition(3).selectExpr("id % 5 as v"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.orderBy("v").collect())) and df.select(common.RID).distinct().count() == 50


def test_local_folders_are_refused_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session, "x")
