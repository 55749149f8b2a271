"""Running streaming queries to completion into files, and reading the results back.

All scratch data (staged sources, sinks, streaming checkpoints, state
versions) lives below the session's shared checkpoint folder, never in a
machine-local temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tempolens_streams/{name}-{uuid.uuid4().hex[:12]}"


def stage_files(df: DataFrame, path: str, order_col: str | None = None, chunks: int = 4, fmt: str = "parquet") -> list[str]:
    """Write ``df`` once, as ``chunks`` folders of consecutive ranges of ``order_col``; returns the folders in order.

    The source is read once for the range bounds (one small aggregate) and once
    for the partitioned write, by as many tasks as it has partitions.  Every row
    is written exactly once; rows without an order value are in the first
    folder.  ``deliver`` then moves one folder after the other into a stream's
    source folder.
    """
    part = F.lit(0)
    if order_col is not None and chunks > 1:
        at = F.unix_micros(F.col(order_col).cast("timestamp"))
        bounds = df.select(F.percentile_approx(at, [i / chunks for i in range(1, chunks)], 1000)).first()[0]
        for k, b in enumerate(bounds or [], 1):
            part = F.when(at > F.lit(b), k).otherwise(part)
    getattr(df.withColumn("_chunk", part).write.partitionBy("_chunk"), fmt)(path)
    return [f"{path}/_chunk={k}" for k in range(chunks if order_col is not None else 1)]


def deliver(spark: SparkSession, folder: str, source: str) -> int:
    """Move the files of a staged folder into a stream's source folder (renames only); returns their number."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(source))
    if not fs.exists(path(folder)):
        return 0  # a range without rows
    files = [f.getPath() for f in fs.listStatus(path(folder)) if not f.getPath().getName().startswith(("_", "."))]
    chunk = folder.rstrip("/").rsplit("/", 1)[-1].replace("_chunk=", "chunk")  # one task's files have one name in all folders
    for f in files:
        if not fs.rename(f, path(f"{source}/{chunk}-{f.getName()}")):
            raise OSError(f"{f} could not be moved to {source}")
    return len(files)


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers n of the finished tables ``kind=n`` in a folder."""
    path, fs = _hadoop(spark, folder)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
    numbers = [int(x.split("=", 1)[1]) for x in names if x.startswith(f"{kind}=")]
    return sorted(n for n in numbers if fs.exists(_hadoop(spark, f"{folder}/{kind}={n}/_SUCCESS")[0]))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, fs = _hadoop(spark, folder)
    fs.delete(path, True)


#: State store for keyed state with a time to live.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(stream: DataFrame, out_path: str, cp_path: str, mode: str = "append",
                      keys: list[str] | None = None, state_store: str | None = None) -> None:
    """Run a streaming DataFrame over everything available, then stop.

    ``state_store`` names the state store of this query, which then has no batches
    without rows (a time to live would ask for one after the other); the session's
    settings are put back.

    append:   file sink (exactly-once through the sink's commit log).
    update:   foreachBatch writes each micro-batch's changed rows as version
              ``batch=<id>`` (overwrite, so a retried batch replaces itself);
              ``latest_versions`` reads the newest row per key.
    complete: foreachBatch overwrites the whole result each micro-batch.
    """
    if state_store:
        conf = stream.sparkSession.conf
        own = {"spark.sql.streaming.stateStore.providerClass": state_store, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
        usual = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            return run_available_now(stream, out_path, cp_path, mode, keys)
        finally:
            for k, v in usual.items():
                conf.unset(k) if v is None else conf.set(k, v)
    w = stream.writeStream.option("checkpointLocation", cp_path).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out_path).start()
    elif mode == "update":
        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        q = w.outputMode("update").foreachBatch(upsert).start()
    elif mode == "complete":
        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out_path)
        q = w.outputMode("complete").foreachBatch(replace).start()
    else:
        raise ValueError(mode)
    q.awaitTermination()


def latest_versions(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key written by an update-mode run."""
    df = spark.read.parquet(out_path)
    vals = [c for c in df.columns if c not in keys and c != "batch"]
    g = df.groupBy(*keys).agg(F.max(F.struct(F.col("batch"), *[F.col(c) for c in vals])).alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])
