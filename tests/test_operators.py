"""Operators checked against brute force on small hand-made inputs."""

import random
import re

from pyspark.sql import functions as F

from tempolens.operators.grouping import period_compare, rollup_total
from tempolens.operators.lookup import resolve_by_range
from tempolens.operators.queue import queue_balance
from tempolens.operators.series import top_x_series
from tempolens.operators.textscan import call_argument_scan
from tempolens.plans.rules import RULES, apply_rule


def test_bucketed_range_join_equals_brute_force(spark):
    rnd = random.Random(7)
    ranges = [(rnd.randint(0, 2), s, rnd.randint(1, 300), i) for i, s in enumerate(range(0, 6000, 250))]
    points = [(rnd.randint(0, 2), rnd.randint(0, 6500), j) for j in range(400)]
    r = spark.createDataFrame(ranges, "f int, start long, len long, obj int")
    p = spark.createDataFrame(points, "f int, pos long, pid int")
    got = {(x.pid, x.obj) for x in resolve_by_range(p, r, ["f"], "pos", "start", "len", bucket=64).collect()}
    want = {(pid, obj) for f, pos, pid in points for f2, s, ln, obj in ranges if f == f2 and s <= pos <= s + ln - 1}
    assert got == want


def _scan_brute(text, func="NVL"):
    """Reference semantics: for each occurrence, relative bracket depth from the end of the name."""
    u = text.upper()
    out = []
    for k, m in enumerate(re.finditer(func, u), start=1):
        sub = u[m.start() + len(func):]
        depth, komma, ende, opens = 0, None, None, []
        for lvl, ch in enumerate(sub, start=1):
            if ch == "(":
                depth += 1
                opens.append(lvl)
            elif ch == ")":
                depth -= 1
            if ch == "," and depth == 1 and komma is None:
                komma = lvl
            if ch in "()," and lvl > 3 and depth == 0 and ende is None:
                ende = lvl
        if komma is None or ende is None:
            continue
        out += [(k, lvl, sub[:ende]) for lvl in opens if komma <= lvl <= ende]
    return sorted(out)


def test_call_argument_scan_equals_brute_force(spark):
    texts = ["SELECT NVL(a, f(b)) FROM t", "select nvl(a, nvl(b, g(c, d))) x, nvl(e, 1) from t",
             "SELECT 1 FROM dual", "SELECT NVL(a,(b)) , NVL(x, SUBSTR(y, 1, 2)) FROM t WHERE NVL(z, 0) = 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, txt string")
    got = {}
    for r in call_argument_scan(df, "id", "txt").collect():
        got.setdefault(r.id, []).append((r.call_no, r.open_bracket_position, r.call_parameter))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == _scan_brute(t), t


def test_top_x_series_zero_fill_and_cut(spark):
    rows = [(1, "a", 5.0), (1, "b", 1.0), (2, "a", 2.0), (3, "c", 9.0), (3, "b", 1.0)]
    df = spark.createDataFrame(rows, "t int, c string, v double")
    out = {(r.t, r.c): r.v for r in top_x_series(df, "t", "c", "v", 2).collect()}
    # totals: c=9, a=7, b=2 -> keep c and a, every slot gets both
    assert out == {(1, "a"): 5.0, (1, "c"): 0.0, (2, "a"): 2.0, (2, "c"): 0.0, (3, "a"): 0.0, (3, "c"): 9.0}


def test_period_compare_single_pass_equals_two_aggregates(spark):
    rnd = random.Random(3)
    rows = [(f"s{rnd.randint(0, 9)}", rnd.randint(1, 20), rnd.randint(0, 5), rnd.randint(1, 1000)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, snap int, ex long, el long")
    got = {r.k: (r.executions_t1, r.executions_t2) for r in
           period_compare(df, ["k"], F.col("snap") <= 10, F.col("snap") > 10, "ex", "el", min_pct=0.0).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        e1 = sum(r[2] for r in rows if r[0] == k and r[1] <= 10)
        e2 = sum(r[2] for r in rows if r[0] == k and r[1] > 10)
        l1 = sum(r[3] for r in rows if r[0] == k and r[1] <= 10)
        l2 = sum(r[3] for r in rows if r[0] == k and r[1] > 10)
        if e1 > 0 and e2 > 0 and l2 / e2 > l1 / e1:
            want[k] = (e1, e2)
    assert got == want


def test_rollup_total_labels(spark):
    df = spark.createDataFrame([("x", "T", 1), ("x", "I", 2), ("y", "T", 4)], "o string, t string, b int")
    out = {(r.o, r.t): (r.b, r.level) for r in rollup_total(df, ["o", "t"], {"b": F.sum("b")}).collect()}
    assert out[("TOTAL", "TOTAL")] == (7, 2) and out[("x", "TOTAL")] == (3, 1) and out[("y", "T")] == (4, 0)


def test_queue_balance_backwards_from_current(spark):
    cur = spark.createDataFrame([(1, 10)], "k int, current_length long")
    flows = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 2, 4), (1, 3, 0, 3)], "k int, slot int, inflow long, outflow long")
    out = {r.slot: r.queue_length_before for r in queue_balance(cur, flows, "k", "slot").collect()}
    # before slot 3: 10 - (0-3) = 13; before slot 2: 13 - (2-4) = 15; before slot 1: 15 - (5-1) = 11
    assert out == {3: 13, 2: 15, 1: 11}


def test_rule_registry():
    assert len(RULES) >= 70
    assert all(r.group for r in RULES.values())
    try:
        apply_rule("R55", {}, not_a_param=1)
    except TypeError:
        pass
    else:
        raise AssertionError("unknown parameter accepted")


def test_range_lookup_with_ranges_of_all_lengths(spark):
    import random
    rnd = random.Random(4)
    ranges = [(f, rnd.randrange(0, 5000), rnd.choice([1, 3, 16, 17, 130, 1100, 9000]), i) for i, f in enumerate([1, 2] * 40)]
    points = [(rnd.choice([1, 2]), rnd.randrange(0, 15000), i) for i in range(300)]
    r = spark.createDataFrame(ranges + [(1, 5, 0, 900), (1, 5, -3, 901)], "file_id int, start long, len long, rid int")
    p = spark.createDataFrame(points, "file_id int, block long, pid int")
    out = resolve_by_range(p, r, ["file_id"], "block", "start", "len", bucket=16)
    want = sorted((i, k) for f, b, i in points for g, s, n, k in ranges if f == g and s <= b <= s + n - 1)
    assert sorted((x.pid, x.rid) for x in out.collect()) == want and want
    assert resolve_by_range(p, r.filter("false"), ["file_id"], "block", "start", "len").count() == 0
