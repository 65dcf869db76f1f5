"""SparkSession helpers.

The library never creates a session implicitly; callers (tests, bench,
driver) pass one in.  ``get_spark`` is a convenience for local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast joins are only planned for sides Spark has sized below this.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Recommended settings for a large cluster (~1000 executors, ~100 TB input).
# Shuffle partitions start high and AQE coalesces them to ~256 MB each;
# skewed partitions are split; scans read 512 MB splits.  Broadcasts stay
# limited to the sides the operators mark as bounded plus AQE's runtime
# conversion of genuinely small join sides.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Runtime Bloom filters: a selective filter on one join side (e.g. an
    # order-date window) prunes the other side's rows before the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Delete reliable-checkpoint files (quantile value counts and bounds)
    # once their data is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used when present.  Only a local-mode session without the setting
    (tests, laptops) gets a private folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared (HDFS/object store) folder "
            "is required on a cluster")
    path = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpoint(df):
    """Reliable, eager checkpoint of ``df`` in the session's checkpoint folder.

    A missing folder or a failed job raises.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the session's checkpoint folder and read back.

    Cuts the lineage like a checkpoint, but stays columnar: later readers prune
    columns and push filters down, and all of them see the same rows.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
