"""Stream results equal the batch operators (S03, S04 checked here; S01, S02, S05 by the oracle too)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tempolens.sources import fixture
from tempolens.streaming import ROCKSDB, deliver, run_available_now, stage_files, stream_counter_delta, stream_counter_delta_stateful
from tempolens.streaming.operators import parse_usage_line

from conftest import SF001


def test_usage_counts_stream_equals_batch(spark):
    s = {r.month: r.requests for r in E.queries()["s03_stream_usage_counts"](spark, SF001).collect()}
    b = fixture(spark, SF001, "fx_usage_log").select(*parse_usage_line("line")).groupBy("month").count()
    assert s == {r.month: r["count"] for r in b.collect()}


def test_long_transactions_stream_matches_batch_sessions(spark):
    s = E.queries()["s04_stream_long_transactions"](spark, SF001)
    a = fixture(spark, SF001, "fx_ash").filter(F.col("xid").isNotNull()) \
        .withColumn("sample_time", F.col("sample_time").cast("timestamp"))
    b = a.groupBy(F.session_window("sample_time", "30 minutes").alias("sw"), "xid").agg(F.count(F.lit(1)).alias("samples")) \
        .select("xid", F.col("sw.start").cast("timestamp_ntz").alias("session_start"), "samples")
    # the end marker closes the sessions that are open at the end of the input
    assert s.select("xid", "session_start", "samples").exceptAll(b).count() == 0
    assert s.count() == b.count()


def test_staged_rows_arrive_once_with_null_times_first(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"2024-01-{i % 28 + 1:02d} 00:00:00") for i in range(40)], "id long, t string") \
        .selectExpr("id", "cast(t as timestamp) as t")
    folders = stage_files(rows, str(tmp_path / "staged"), "t", 4)
    seen = []
    for k, f in enumerate(folders):
        assert deliver(spark, f, str(tmp_path / "src"))
        now = {r.id for r in spark.read.parquet(str(tmp_path / "src")).collect()}
        new = now - set(seen)
        assert k > 0 or {i for i in range(0, 40, 4)} <= new
        seen += new
    assert sorted(seen) == list(range(40))


def test_a_missing_state_is_an_error(spark, tmp_path):
    src = spark.createDataFrame([(1, 1, 5)], "series_id long, snap_id long, v long")
    d = str(tmp_path)

    def run():
        stream = spark.readStream.schema(src.schema).parquet(d + "/src")
        stream_counter_delta(stream, ["series_id"], "snap_id", ["v"], d + "/out", d + "/state", d + "/cp").awaitTermination()

    src.write.parquet(d + "/src")
    run()
    (tmp_path / "state").rename(tmp_path / "gone")
    src.write.mode("append").parquet(d + "/src")
    with pytest.raises(Exception, match="is missing"):
        run()


def counters(spark, folder, batches, run):
    """Hand the batches to the stream one by one; the deltas of all of them."""
    schema = "series_id long, snap_id long, t timestamp, v long"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder + "/src")
        run(spark.readStream.schema(schema).parquet(folder + "/src"))
    return sorted((r.series_id, r.snap_id, r.v) for r in spark.read.parquet(folder + "/out").collect())


def test_state_log_is_compacted_and_forgets_ended_series(spark, tmp_path):
    from datetime import datetime, timedelta
    day = [datetime(2024, 1, 1) + timedelta(days=n) for n in range(9)]
    # series 1 in every batch, 2 ends after the first, 3 pauses for two days, 4 comes back after its state has gone
    batches = [[(1, n, day[n], 10 * n)] + [(2, 0, day[0], 5)] * (n == 0) + [(3, n, day[n], n * n)] * (n in (0, 3, 4))
               + [(4, n, day[n], 7 + n)] * (n in (0, 7)) for n in range(8)]
    d = str(tmp_path)
    got = counters(spark, d, batches, lambda s: stream_counter_delta(s, ["series_id"], "snap_id", ["v"], d + "/out", d + "/state", d + "/cp",
                                                                     compact_every=2, ts="t", ttl="3 days").awaitTermination())
    want = [(1, n, 10 * (n > 0)) for n in range(8)] + [(2, 0, 0), (3, 0, 0), (3, 3, 9), (3, 4, 7), (4, 0, 0), (4, 7, 0)]
    assert got == sorted(want)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["full=5", "full=7", "v=6", "v=7"]
    assert {r.series_id for r in spark.read.parquet(d + "/state/full=7").collect()} == {1, 3, 4}


@pytest.mark.parametrize("ttl_hours, gone", [(None, False), (24.0, False), (1e-6, True)])
def test_keyed_state_with_time_to_live(spark, tmp_path, ttl_hours, gone):
    d = str(tmp_path)

    def run(stream):
        deltas = stream_counter_delta_stateful(stream, ["series_id"], "snap_id", ["v"], reset="keep", ttl_hours=ttl_hours)
        run_available_now(deltas, d + "/out", d + "/cp", state_store=ROCKSDB)

    got = counters(spark, d, [[(1, 2, None, 30), (1, 1, None, 10)], [(1, 3, None, 45), (2, 1, None, 8)], [(2, 2, None, 3)]], run)
    assert got == [(1, 1, 0), (1, 2, 20), (1, 3, 0 if gone else 15), (2, 1, 0), (2, 2, 0 if gone else -5)]
