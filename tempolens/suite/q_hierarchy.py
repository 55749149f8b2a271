"""Hierarchy family queries (A27-A34; B05, B06, E02, E05-E08, F13, D05, D07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as HY
from ..operators.trees import deepest_levels, tree_numbers
from ..plans import locks
from ..sources import fixture
from .registry import query


def _fx(spark, sf, name):
    return fixture(spark, sf, name)


def _gt1(expr: str, alias: str) -> str:
    n = f"count(DISTINCT {expr})"
    return f"CASE WHEN {n} > 1 THEN '< ' || {n} || ' >' ELSE min(CAST({expr} AS VARCHAR)) END AS {alias}"


ROOTS = """roots AS (SELECT e.* FROM fx_wait_edge e WHERE NOT EXISTS (
  SELECT 1 FROM fx_wait_edge i WHERE i.sample_id = e.sample_id AND i.session_id = e.blocking_session))"""


def _walk(start: str, root_a: str = "sample_id", root_b: str = "blocking_session") -> str:
    return f"""walk AS (
  SELECT {root_a} AS root_{root_a}, {root_b} AS root_{root_b}, sample_id, session_id, blocking_session, seconds_in_wait, 1 AS lvl, [session_id] AS path FROM {start}
  UNION ALL
  SELECT w.root_{root_a}, w.root_{root_b}, e.sample_id, e.session_id, e.blocking_session, e.seconds_in_wait, w.lvl + 1, list_append(w.path, e.session_id)
  FROM walk w JOIN fx_wait_edge e ON e.sample_id = w.sample_id AND e.blocking_session = w.session_id
  WHERE NOT list_contains(w.path, e.session_id))"""


@query("b05_root_blockers", f"""
WITH RECURSIVE {ROOTS}, {_walk('roots')}
SELECT root_sample_id, root_blocking_session, {_gt1('session_id', 'blocked_total')},
  {_gt1('CASE WHEN lvl = 1 THEN session_id END', 'blocked_direct')},
  count(DISTINCT session_id) AS blocked_count, max(lvl) AS max_level, CAST(sum(seconds_in_wait) AS BIGINT) AS seconds_in_wait_total
FROM walk GROUP BY 1, 2""")
def b05(spark, sf):
    return locks.root_blockers(_fx(spark, sf, "fx_wait_edge"))


@query("a27_hierarchy_walk_nocycle_all_roots", f"""
WITH RECURSIVE {_walk('fx_wait_edge')}
SELECT root_sample_id, root_blocking_session, sample_id, session_id, lvl AS level, path FROM walk""")
def a27(spark, sf):
    w = locks.blocking_walk(_fx(spark, sf, "fx_wait_edge"))
    return w.select("root_sample_id", "root_blocking_session", "sample_id", "session_id", "level", "path")


@query("a28_root_only", """
SELECT e.sample_id, e.session_id, e.blocking_session FROM fx_wait_edge e WHERE NOT EXISTS (
  SELECT 1 FROM fx_wait_edge i WHERE i.sample_id = e.sample_id AND i.session_id = e.blocking_session)""")
def a28(spark, sf):
    r = HY.root_only(_fx(spark, sf, "fx_wait_edge"), ["blocking_session"], ["session_id"], ["sample_id"])
    return r.select("sample_id", "session_id", "blocking_session")


@query("a29_deepest_occurrence", f"""
WITH RECURSIVE {_walk('fx_wait_edge')}
SELECT sample_id, session_id, max(lvl) AS level FROM walk GROUP BY 1, 2""")
def a29(spark, sf):
    w = deepest_levels(_fx(spark, sf, "fx_wait_edge"), "blocking_session", "session_id", ["sample_id"])
    return w.select("sample_id", "session_id", "level").distinct()


@query("a30_e02_lock_tree_deepest", f"""
WITH RECURSIVE {ROOTS}, {_walk('roots')},
deep AS (SELECT sample_id, session_id, max(lvl) AS m FROM walk GROUP BY 1, 2)
SELECT DISTINCT w.sample_id, w.session_id, w.blocking_session, w.root_blocking_session, w.lvl AS level
FROM walk w JOIN deep d ON d.sample_id = w.sample_id AND d.session_id = w.session_id AND d.m = w.lvl""")
def e02(spark, sf):
    return locks.lock_tree(_fx(spark, sf, "fx_wait_edge"))


@query("b06_blocked_by_one_blocker", f"""
WITH RECURSIVE start AS (SELECT * FROM fx_wait_edge WHERE blocking_session = 4), {_walk('start')}
SELECT session_id, min(lvl) AS min_level, max(lvl) AS max_level, count(DISTINCT sample_id) AS samples,
  CAST(sum(seconds_in_wait) AS BIGINT) AS seconds_in_wait FROM walk GROUP BY 1""")
def b06(spark, sf):
    return locks.blocked_by(_fx(spark, sf, "fx_wait_edge"), 4)


@query("e05_root_blockers_overall", f"""
WITH RECURSIVE {ROOTS}, {_walk('roots')}
SELECT root_blocking_session, count(DISTINCT root_sample_id) AS samples, count(DISTINCT session_id) AS blocked_sessions,
  CAST(sum(seconds_in_wait) AS BIGINT) AS seconds_in_wait_total, max(lvl) AS max_level FROM walk GROUP BY 1""")
def e05(spark, sf):
    return locks.root_blockers_overall(_fx(spark, sf, "fx_wait_edge"))


@query("e06_second_level", f"""
WITH RECURSIVE start AS (SELECT * FROM fx_wait_edge WHERE blocking_session = 0),
walk AS (
  SELECT session_id AS root_session_id, sample_id, session_id, seconds_in_wait, 1 AS lvl, [session_id] AS path FROM start
  UNION ALL
  SELECT w.root_session_id, e.sample_id, e.session_id, e.seconds_in_wait, w.lvl + 1, list_append(w.path, e.session_id)
  FROM walk w JOIN fx_wait_edge e ON e.sample_id = w.sample_id AND e.blocking_session = w.session_id
  WHERE NOT list_contains(w.path, e.session_id))
SELECT root_session_id, {_gt1('session_id', 'blocked_total')}, {_gt1('CASE WHEN lvl = 1 THEN session_id END', 'blocked_direct')},
  count(DISTINCT session_id) AS blocked_count, max(lvl) AS max_level, CAST(sum(seconds_in_wait) AS BIGINT) AS seconds_in_wait_total
FROM walk GROUP BY 1""")
def e06(spark, sf):
    return locks.second_level(_fx(spark, sf, "fx_wait_edge"), 0)


@query("e08_chain_of_causes", """
WITH RECURSIVE walk AS (
  SELECT sample_id AS root_sample_id, sample_id, session_id, blocking_session, 1 AS lvl, [session_id] AS path FROM fx_wait_edge WHERE session_id = 18
  UNION ALL
  SELECT w.root_sample_id, e.sample_id, e.session_id, e.blocking_session, w.lvl + 1, list_append(w.path, e.session_id)
  FROM walk w JOIN fx_wait_edge e ON e.sample_id = w.sample_id AND e.session_id = w.blocking_session
  WHERE NOT list_contains(w.path, e.session_id))
SELECT root_sample_id, session_id, blocking_session, lvl AS level FROM walk""")
def e08(spark, sf):
    return locks.chain_of_causes(_fx(spark, sf, "fx_wait_edge"), 18)


def _lock_registry():
    return {"session": F.col("session_id"), "blocking_session": F.col("blocking_session"),
            "sql_id": F.col("sql_id"), "module": F.col("module"), "event": F.col("event"),
            "instance": F.col("instance_number")}


@query("e07_lock_drilldown_by_blocker", """
SELECT blocking_session, count(*) AS records, CAST(sum(time_waited) AS BIGINT) AS wait_total, """ + ", ".join(
    f"CASE WHEN count(DISTINCT coalesce(CAST({c} AS VARCHAR), ' ')) = 1 THEN CAST(min({c}) AS VARCHAR) ELSE '< ' || count(DISTINCT coalesce(CAST({c} AS VARCHAR), ' ')) || ' >' END AS {a}"
    for a, c in [("session", "session_id"), ("sql_id", "sql_id"), ("module", "module"), ("event", "event"), ("instance", "instance_number")])
    + " FROM fx_ash WHERE blocking_session IS NOT NULL AND instance_number = 2 GROUP BY 1")
def e07(spark, sf):
    rows = _fx(spark, sf, "fx_ash").filter(F.col("blocking_session").isNotNull())
    return locks.lock_drilldown(rows, _lock_registry(), "blocking_session", {"instance": 2}, wait="time_waited")


_LOCK_NAME = "lower(coalesce(blocking_object_schema, '')) || '.' || coalesce(blocking_object_name, '')"
LOCK_KEYS_SQL = {"instance": "instance_number", "sid": "sid", "serialno": "serialno", "blocking_object": _LOCK_NAME, "sql_id": "sql_id", "module": "module",
                 "object_name": "object_name", "lock_type": "lock_type", "request": "request", "lock_mode": "lock_mode", "blocking_rowid": "blocking_rowid",
                 "blocking_instance": "blocking_instance_number", "blocking_sid": "blocking_sid", "blocking_sql_id": "blocking_sql_id",
                 "sql_child_number": "sql_child_number", "blocking_serialno": "blocking_serialno", "blocking_sql_child_number": "blocking_sql_child_number"}


def _lock_group_sql(by: str, where: str) -> str:
    cols = ",\n  ".join(f"CASE WHEN count(DISTINCT {e}) = 1 THEN CAST(min({e}) AS VARCHAR) ELSE '< ' || count(DISTINCT {e}) || ' >' END AS {k}"
                        for k, e in LOCK_KEYS_SQL.items())
    return f"""SELECT {LOCK_KEYS_SQL[by]} AS group_value, min(snapshot_ts) AS first_time, max(snapshot_ts) AS last_time,
  CAST(sum(seconds_in_wait) AS BIGINT) AS seconds_in_wait, count(*) AS samples,
  {cols}
FROM fx_lock_history WHERE {where} GROUP BY ALL"""


@query("e07_lock_history_by_object", _lock_group_sql("object_name", "coalesce(CAST(blocking_sid AS VARCHAR), '0') <> '0' AND snapshot_ts >= TIMESTAMP '2024-01-05' AND snapshot_ts <= TIMESTAMP '2024-01-25'"))
def e07_object(spark, sf):
    return locks.lock_history_grouping(_fx(spark, sf, "fx_lock_history"), "object_name", {"hide_non_blocking": 0, "from": "2024-01-05", "to": "2024-01-25"})


@query("e07_lock_history_by_blocking_object", _lock_group_sql("blocking_object", "lock_type = 'TX' AND blocking_rowid IS NULL"))
def e07_blocking_object(spark, sf):
    return locks.lock_history_grouping(_fx(spark, sf, "fx_lock_history"), "blocking_object", {"lock_type": "TX", "blocking_rowid": ""})


def _lob_sql(c: str) -> str:
    return f"""CASE WHEN {c} LIKE 'SYS\\_LOB%' ESCAPE '\\' THEN {c} || ' (' || coalesce((SELECT o.object_name FROM fx_object o WHERE o.object_id = TRY_CAST(substr({c}, 8, 10) AS BIGINT)), '') || ')'
    WHEN {c} LIKE 'SYS\\_IL%' ESCAPE '\\' THEN {c} || ' (' || coalesce((SELECT o.object_name FROM fx_object o WHERE o.object_id = TRY_CAST(substr({c}, 7, 10) AS BIGINT)), '') || ')' ELSE {c} END"""


@query("e07_lock_history_records", f"""
SELECT l.* REPLACE ({_lob_sql('l.object_name')} AS object_name, {_lob_sql('l.blocking_object_name')} AS blocking_object_name, lower(blocking_object_schema) AS blocking_object_schema)
FROM fx_lock_history l WHERE blocking_instance_number = 2 AND request = 6""")
def e07_records(spark, sf):
    return locks.lock_history_records(_fx(spark, sf, "fx_lock_history"), _fx(spark, sf, "fx_object"), {"blocking_instance": 2, "request": 6})


def _closure_sql(edges: str, start: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {edges} WHERE child_table <> parent_table),
walk AS (
  SELECT child_table, parent_table, 1 AS lvl, [child_table] AS path FROM e WHERE parent_table = '{start}'
  UNION ALL
  SELECT e.child_table, e.parent_table, w.lvl + 1, list_append(w.path, e.child_table)
  FROM walk w JOIN e ON e.parent_table = w.child_table WHERE NOT list_contains(w.path, e.child_table))
SELECT child_table, max(lvl) AS level FROM walk GROUP BY 1"""


@query("f13_table_dependency_closure", _closure_sql("fx_table_ref", "T1"))
def f13(spark, sf):
    return locks.table_closure(_fx(spark, sf, "fx_table_ref"), "T1")


PLAN_WALK = """walk AS (
  SELECT plan_hash_value, id, parent_id, 1 AS lvl, [id] AS path FROM fx_plan p
  WHERE NOT EXISTS (SELECT 1 FROM fx_plan q WHERE q.plan_hash_value = p.plan_hash_value AND q.id = p.parent_id)
  UNION ALL
  SELECT c.plan_hash_value, c.id, c.parent_id, w.lvl + 1, list_append(w.path, c.id)
  FROM walk w JOIN fx_plan c ON c.plan_hash_value = w.plan_hash_value AND c.parent_id = w.id
  WHERE NOT list_contains(w.path, c.id))"""


def plan_walk(spark, sf, name="fx_plan"):
    p = _fx(spark, sf, name)
    roots = HY.root_only(p, ["parent_id"], ["id"], ["plan_hash_value"])
    return HY.hierarchy_walk(p, connect=[("id", "parent_id")], same=["plan_hash_value"], start=roots, node=["id"])


@query("a31_post_order_number", f"""
WITH RECURSIVE {PLAN_WALK}
SELECT plan_hash_value, id, parent_id, lvl AS level,
  row_number() OVER (PARTITION BY plan_hash_value ORDER BY list_append(path, CAST({HY.SENTINEL} AS BIGINT))) AS exec_order
FROM walk""")
def a31(spark, sf):
    return tree_numbers(_fx(spark, sf, "fx_plan"), ["plan_hash_value"]).select("plan_hash_value", "id", "parent_id", "level", "exec_order")


def _norm_name_sql(c="object_name"):
    return f"CASE WHEN {c} LIKE ':TQ%' THEN ':TQ' ELSE {c} END"


def _norm_name(c="object_name"):
    return F.when(F.col(c).like(":TQ%"), F.lit(":TQ")).otherwise(F.col(c))


@query("a32_variant_compare", f"""
SELECT plan_hash_value, id,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner, {_norm_name_sql()}) AS strict_count,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner) AS loose_count
FROM fx_plan_multi""")
def a32(spark, sf):
    p = _fx(spark, sf, "fx_plan_multi")
    out = HY.variant_compare(p, ["parent_id", "operation", "object_owner", _norm_name()],
                             ["parent_id", "operation", "object_owner"])
    return out.select("plan_hash_value", "id", "strict_count", "loose_count")


@query("a33_positional_compare", f"""
WITH per AS (SELECT id, count(DISTINCT coalesce(CAST(parent_id AS VARCHAR), '~') || '|' || operation || '|' || object_owner || '|' || {_norm_name_sql()}) AS variants,
  count(*) AS n FROM fx_plan_multi GROUP BY 1)
SELECT p.plan_hash_value, p.id, (per.variants > 1 OR per.n < (SELECT count(DISTINCT plan_hash_value) FROM fx_plan_multi)) AS plan_different
FROM fx_plan_multi p JOIN per ON per.id = p.id""")
def a33(spark, sf):
    p = _fx(spark, sf, "fx_plan_multi")
    out = HY.positional_compare(p, "plan_hash_value", "id", ["parent_id", "operation", "object_owner", _norm_name()])
    return out.select("plan_hash_value", "id", "plan_different")


@query("d07_compare_two_plans", f"""
SELECT plan_hash_value, id,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner, {_norm_name_sql()}) AS strict_count,
  count(*) OVER (PARTITION BY parent_id, operation, object_owner) AS loose_count
FROM fx_plan_multi WHERE plan_hash_value IN (1, 2)""")
def d07(spark, sf):
    p = _fx(spark, sf, "fx_plan_multi").filter(F.col("plan_hash_value").isin(1, 2))
    out = HY.variant_compare(p, ["parent_id", "operation", "object_owner", _norm_name()],
                             ["parent_id", "operation", "object_owner"])
    return out.select("plan_hash_value", "id", "strict_count", "loose_count")


@query("a34_subtree_self_join", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY plan_hash_value, parent_id ORDER BY id) AS child_no FROM fx_plan_multi),
base AS (SELECT p.plan_hash_value, p.id AS p_id, c1.id AS c1_id, c2.id AS c2_id FROM r p
  JOIN r c1 ON c1.plan_hash_value = p.plan_hash_value AND c1.parent_id = p.id AND c1.child_no = 1
  JOIN r c2 ON c2.plan_hash_value = p.plan_hash_value AND c2.parent_id = p.id AND c2.child_no = 2),
d1 AS (SELECT b.*, 1 AS d_level, x.id AS d_id FROM base b JOIN r x ON x.plan_hash_value = b.plan_hash_value AND x.parent_id = b.c2_id),
d2 AS (SELECT b.plan_hash_value, b.p_id, b.c1_id, b.c2_id, 2 AS d_level, x.id AS d_id FROM d1 b JOIN r x ON x.plan_hash_value = b.plan_hash_value AND x.parent_id = b.d_id)
SELECT plan_hash_value, p_id, c1_id, c2_id, 0 AS d_level, c2_id AS d_id FROM base
UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""")
def a34(spark, sf):
    out = HY.subtree_self_join(_fx(spark, sf, "fx_plan_multi"), ["plan_hash_value"], depth=2)
    return out.select("plan_hash_value", "p_id", "c1_id", "c2_id", "d_level", "d_id")
