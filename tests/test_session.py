import os

from pyspark.sql import functions as F

from gatherlens.session import checkpoint_dir, configure, materialize, scratch_dir


def test_configure_pins_runtime_settings(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_materialize_checkpoints_to_the_session_folder(spark):
    assert checkpoint_dir(spark)                      # the tests name a folder under /tmp
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    out = materialize(df)
    assert out.count() == 100 and out.agg(F.sum("x")).first()[0] == 9900
    # the rows were written under the checkpoint folder
    folder = checkpoint_dir(spark).replace("file:", "")
    assert any(files for _, _, files in os.walk(folder))


def test_scratch_folders_lie_in_the_session_folder(spark):
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(checkpoint_dir(spark))


def test_cluster_conf_sizes_partitions():
    from gatherlens.session import cluster_conf
    big = cluster_conf(100 * (1 << 40), 4000)
    assert big["spark.sql.shuffle.partitions"] == str((100 << 40) // (128 << 20))
    small = cluster_conf(1 << 30, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 256 << 20
