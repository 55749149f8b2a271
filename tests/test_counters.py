"""Counter deltas on hand-made series: resets, ties, chunked = single window."""

import pytest
from pyspark.sql import functions as F

from tempolens.operators.counters import counter_delta, drop_first_snapshot, first_last_delta


def _series(spark):
    rows = [(1, 1, 10), (1, 2, 15), (1, 3, 3), (1, 4, 8),      # reset at snap 3
            (2, 1, 5), (2, 2, 5), (2, 3, 9),
            (3, 7, 100)]                                         # single row
    return spark.createDataFrame(rows, "k int, snap int, c long")


def test_reset_policies(spark):
    df = _series(spark)
    drop = {(r.k, r.snap): r.c for r in counter_delta(df, ["k"], "snap", ["c"], "drop").collect()}
    assert drop == {(1, 1): 0, (1, 2): 5, (1, 4): 5, (2, 1): 0, (2, 2): 0, (2, 3): 4, (3, 7): 0}
    pos = {(r.k, r.snap) for r in counter_delta(df, ["k"], "snap", ["c"], "positive").collect()}
    assert pos == {(1, 2), (1, 4), (2, 3)}
    keep = counter_delta(df, ["k"], "snap", ["c"], "keep").filter("k = 1 AND snap = 3").first().c
    assert keep == -12


def test_chunked_equals_single_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("snap"),
                                     (F.col("id") * 7 % 1000).alias("c"))
    a = counter_delta(df, ["k"], "snap", ["c"], "keep")
    b = counter_delta(df, ["k"], "snap", ["c"], "keep", chunk=F.floor(F.col("snap") / 97))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sum_of_deltas_is_last_minus_first(spark):
    df = spark.range(1, 200).select(F.lit(1).alias("k"), F.col("id").alias("snap"), (F.col("id") * F.col("id")).alias("c"))
    total = counter_delta(df, ["k"], "snap", ["c"], "drop").agg(F.sum("c")).first()[0]
    assert total == 199 * 199 - 1


def test_drop_first_snapshot_and_first_last(spark):
    df = _series(spark)
    assert drop_first_snapshot(df, ["k"], "snap").count() == 5
    fl = {r.k: r.c for r in first_last_delta(df, ["k"], "snap", ["c"]).collect()}
    assert fl == {1: -2, 2: 4, 3: 0}


def test_null_keys_and_null_orders_keep_their_deltas_in_chunks(spark):
    rows = [(k, s, s * 7 % 1000 + s * 10) for k in (1, None) for s in range(0, 5000, 100)] + [(None, None, 3), (1, None, 2)]
    df = spark.createDataFrame(rows, "k int, snap int, c long")
    a = counter_delta(df, ["k"], "snap", ["c"], reset="keep", chunk="auto")
    b = counter_delta(df, ["k"], "snap", ["c"], reset="keep", chunk=None)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_the_chunked_form_reads_its_facts_once(spark, tmp_path):
    spark.createDataFrame([(1, s, s) for s in range(3000)], "k int, snap int, c long").write.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = counter_delta(spark.read.parquet(str(tmp_path / "f")), ["k"], "snap", ["c"], reset="keep")
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_an_order_without_chunks_is_an_error(spark):
    with pytest.raises(ValueError):
        counter_delta(spark.createDataFrame([(1, "a", 1)], "k int, snap string, c long"), ["k"], "snap", ["c"])
