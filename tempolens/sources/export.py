"""Writing monitoring exports in a layout that lets Spark prune and co-locate.

History tables are large and almost always filtered by time and database:
partitioning them by (dbid, day) turns those filters into partition pruning
(``PartitionFilters`` in the scan), including dynamic pruning when the time
range comes from a joined snapshot table.  Tables joined repeatedly on the
same keys (statement statistics and plan lines on sql_id) can be written
bucketed on those keys so the joins need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_history(df: DataFrame, path: str, time_col: str, by=("dbid",), mode: str = "overwrite") -> None:
    """Write a history table partitioned by ``by`` and the day of ``time_col``.

    Rows are clustered by the partition columns first so every task writes
    few files per partition.
    """
    parts = [*by, "day"]
    out = df.withColumn("day", F.to_date(F.col(time_col)))
    out.repartition(*[F.col(c) for c in parts]).write.mode(mode).partitionBy(*parts).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by ``write_history`` (partition columns are discovered from the paths)."""
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, sort: bool = True,
                   mode: str = "overwrite") -> None:
    """Save a metastore table bucketed (and sorted) on ``keys`` for shuffle-free joins on them."""
    w = df.write.mode(mode).bucketBy(buckets, *keys)
    if sort:
        w = w.sortBy(*keys)
    w.saveAsTable(table)


def time_range(col: str, start, end):
    """Filter on the day partition and the exact time: prunes partitions, then keeps exact bounds."""
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    return (F.col("day").between(F.to_date(s), F.to_date(e))) & (F.col(col) >= s) & (F.col(col) <= e)
