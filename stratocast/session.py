"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library depends on for correctness (UTC timestamps) and for
# scale (AQE re-plans shuffles and splits skewed partitions at run time).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "stratocast", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only a session without it (local tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="stratocast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the checkpoint directory for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


MAX_SHUFFLE_PARTITIONS = 40_000


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 << 20, shuffled_bytes: int | None = None) -> dict[str, str]:
    """Settings sized for a large input (for spark-submit or the builder).

    Scan splits follow the input, shuffle partitions what is shuffled
    (``shuffled_bytes``; a twentieth of the input unless given, as most
    operators aggregate before they shuffle): about ``target_partition_bytes``
    per task, at least two tasks per core. A shuffle of m map tasks into n
    partitions makes m x n blocks, so their number is bounded; AQE coalesces
    small partitions and splits skewed ones.
    """
    slots = max(1, executors * cores_per_executor)
    moved = input_bytes // 20 if shuffled_bytes is None else shuffled_bytes
    shuffle = max(slots * 2, min(MAX_SHUFFLE_PARTITIONS, int(moved // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.default.parallelism": str(slots * 2),
        "spark.sql.session.timeZone": "UTC",
        "spark.task.maxFailures": "8",
        "spark.stage.maxConsecutiveAttempts": "8",
        "spark.ui.enabled": "false",
    }


def stream_conf(executors: int, cores_per_executor: int = 4) -> dict[str, str]:
    """Settings for a streaming job: a state store per shuffle partition, so
    one per core and no more (fixed for the life of its checkpoint)."""
    return {"spark.sql.shuffle.partitions": str(max(1, executors * cores_per_executor)), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
