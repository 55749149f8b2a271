"""Partitioned history exports prune on day and database."""

import tempfile

from pyspark.sql import functions as F

from tempolens.sources import fixture
from tempolens.sources.export import read_history, time_range, write_history

from conftest import SF001


def test_history_partition_pruning(spark):
    path = tempfile.mkdtemp(prefix="tempolens-hist-", dir="/tmp") + "/ash"
    ash = fixture(spark, SF001, "fx_ash").withColumn("dbid", F.lit(1))
    write_history(ash, path, "sample_time")
    h = read_history(spark, path)
    q = h.filter((h.dbid == 1) & time_range("sample_time", "2024-01-10 00:00:00", "2024-01-11 12:00:00"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = ash.filter((ash.sample_time >= "2024-01-10 00:00:00") & (ash.sample_time <= "2024-01-11 12:00:00")).count()
    assert q.count() == want
