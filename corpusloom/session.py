"""Session set-up and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: str = "8", app: str = "corpusloom") -> SparkSession:
    """A session for tests and the bench; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder on this machine; on a
    cluster an unset folder is an error, because executors could not share it.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder."""
    return os.path.join(work_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(
    df: DataFrame, name: str, partition_by: list[str] | None = None, keep_shuffles: bool = True
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and lets several
    branches reuse one computation.  Without ``keep_shuffles`` the shuffle files
    of the write go as soon as it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    was = spark.conf.get(SHUFFLE_CLEANUP_CONF, "false")
    if not keep_shuffles:
        spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, was)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once in buckets of ``key``, and read it back.

    One shuffle of the wide rows, after which every join of them on ``key`` (ids that
    go, topics, splits, scores) moves the other side alone.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_path(spark, name)
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path)
    writer.format("parquet").saveAsTable(table)
    return spark.table(table)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a freshly read table enough tasks for heavy per-row work.

    A small file, or one with few row groups, keeps a single task busy however
    many cores there are.  A table whose scan already has several tasks per core
    is returned as it is, so large data is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(2 * cores, *keys)
