import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leaksieve.operators import layout
from workload.model import spread


@pytest.mark.parametrize("split", [True, False])
def test_join_on_skewed_key(spark, split):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", str(split).lower())
    try:
        check_join_on_skewed_key(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_adaptive_execution_splits_a_hot_key(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
        )
        few = spark.range(-1, 1000).withColumnRenamed("id", "k")
        joined = layout.join_on_skewed_key(many, few, "k")
        assert joined.count() == 66_667 + 666
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def check_join_on_skewed_key(spark):
    many = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"),
        F.col("id").cast("string").alias("commit"),
        F.lit("/p").alias("path"),
    )
    few = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("nowhere", 5)], "k string, v int"
    )
    hot = layout.hot_keys(many, "k").collect()
    assert [(r["k"], r["salts"]) for r in hot] == [("hot", 334)]
    got = sorted(map(tuple, layout.join_on_skewed_key(many, few, "k").collect()))
    want = sorted(map(tuple, many.join(few, "k").select("k", "commit", "path", "v").collect()))
    assert got == want and len(got) == 2 * 1667 + 2


def test_dense_positions(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.xxhash64("id").alias("x"),
    )
    got = layout.dense_positions(df, "g", ["x"])
    want = df.withColumn(
        "pos", (F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1).cast("long")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    few = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert spread(few, "id").rdd.getNumPartitions() >= cores or cores == 1
    many = spark.range(0, 100, 1, cores * 2)
    assert spread(many, "id") is many


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        layout.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y"}
    assert layout.shared_folder(Session) == "hdfs://x/y"


def test_checkpoint_folder_of_the_cluster_wins(spark):
    layout.reliable(spark.range(3))
    assert spark.sparkContext.getCheckpointDir().startswith("file:")
