from stratocast.session import cluster_conf, stream_conf, ensure_checkpoint_dir, scratch_path


def test_cluster_conf_sizes_partitions():
    c = cluster_conf(100 << 40, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) == (5 << 40) // (256 << 20)
    assert int(cluster_conf(1 << 60, 1000)["spark.sql.shuffle.partitions"]) == 40_000
    assert int(cluster_conf(100 << 40, 10, shuffled_bytes=1 << 40)["spark.sql.shuffle.partitions"]) == (1 << 40) // (256 << 20)
    assert stream_conf(10)["spark.sql.shuffle.partitions"] == "40"
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.session.timeZone"] == "UTC"
    small = cluster_conf(1 << 20, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 80          # at least two per core


def test_checkpoint_dir_is_reused(spark):
    a = ensure_checkpoint_dir(spark)
    assert a and ensure_checkpoint_dir(spark) == a
    assert scratch_path(spark, "x").startswith(a.rstrip("/"))
