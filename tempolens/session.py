"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library relies on.  AQE re-plans joins
# (broadcast when the build side turns out small, split skewed partitions)
# and coalesces small shuffle partitions at run time.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # delete checkpoint files (hierarchy walk levels) once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for large clusters (tens of TB per query): big scan splits, many
# shuffle partitions that AQE coalesces to ~256 MB, skewed partitions split
# above 1 GB, and RocksDB for streaming state that outgrows executor memory.
CLUSTER_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, app: str = "tempolens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None, profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    profile='cluster' adds ``CLUSTER_DEFAULTS`` (sizes for very large inputs).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    if profile == "cluster":
        settings.update(CLUSTER_DEFAULTS)
    for k, v in settings.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare_session(spark: SparkSession) -> None:
    """Runtime settings the operators assume (safe to call on a foreign session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from the session (``spark.checkpoint.dir`` / the context's
    checkpoint dir).  Only a local session without either gets a folder below
    its warehouse directory; on a cluster the setting is required, because a
    path that is not shared would lose what executors write.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        wh = spark.conf.get("spark.sql.warehouse.dir", None) or os.path.abspath("spark-warehouse")
        conf_dir = wh.rstrip("/") + "/_tempolens_checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` computed once, as a table in the shared folder: its lineage ends there, and counts come from its files."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that :func:`written` made."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
