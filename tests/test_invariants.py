"""Invariants on the fixture data."""

from pyspark.sql import functions as F

from tempolens.operators.hierarchy import hierarchy_walk, post_order_number, root_only
from tempolens.operators.series import top_x_series
from tempolens.sources import fixture

from conftest import SF01


def test_roots_never_wait(spark):
    e = fixture(spark, SF01, "fx_wait_edge")
    roots = root_only(e, ["blocking_session"], ["session_id"], ["sample_id"])
    waiting = e.select("sample_id", F.col("session_id").alias("blocking_session"))
    assert roots.join(waiting, ["sample_id", "blocking_session"], "left_semi").count() == 0
    assert roots.count() > 0


def test_post_order_is_permutation_children_first(spark):
    p = fixture(spark, SF01, "fx_plan_multi")
    roots = root_only(p, ["parent_id"], ["id"], ["plan_hash_value"])
    w = hierarchy_walk(p, [("id", "parent_id")], ["plan_hash_value"], start=roots, node=["id"])
    o = post_order_number(w, ["plan_hash_value"]).select("plan_hash_value", "id", "parent_id", "exec_order")
    stats = o.groupBy("plan_hash_value").agg(F.count(F.lit(1)).alias("n"), F.min("exec_order").alias("lo"),
                                             F.max("exec_order").alias("hi"), F.count_distinct("exec_order").alias("d"))
    assert stats.filter((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).count() == 0
    par = o.select("plan_hash_value", F.col("id").alias("parent_id"), F.col("exec_order").alias("parent_order"))
    assert o.join(par, ["plan_hash_value", "parent_id"]).filter(F.col("exec_order") >= F.col("parent_order")).count() == 0


def test_kept_curves_outweigh_dropped(spark):
    s = fixture(spark, SF01, "fx_seg_size").withColumn("gather_date", F.col("gather_date").cast("timestamp_ntz"))
    kept = {r.segment_name for r in top_x_series(s, "gather_date", "segment_name", "size_units", 4, scale=None)
            .select("segment_name").distinct().collect()}
    totals = {r.segment_name: r.t for r in s.groupBy("segment_name").agg(F.sum("size_units").alias("t")).collect()}
    assert len(kept) == 4
    assert min(totals[k] for k in kept) >= max(v for k, v in totals.items() if k not in kept)
