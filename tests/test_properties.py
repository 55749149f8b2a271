"""Property checks: chunked counter deltas equal a plain reference for random series."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempolens.operators.counters import counter_delta

series = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10_000)), min_size=1, max_size=60)


def _reference(rows, reset):
    out = {}
    by_key = {}
    for i, (k, v) in enumerate(rows):
        by_key.setdefault(k, []).append((i, v))
    for k, pts in by_key.items():
        prev = None
        for i, v in pts:
            d = 0 if prev is None else v - prev
            prev = v
            keep = {"drop": d >= 0, "positive": d > 0, "keep": True}[reset]
            if keep:
                out[(k, i)] = d
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=series, width=st.integers(1, 7), reset=st.sampled_from(["drop", "positive", "keep"]))
def test_chunked_delta_matches_reference(spark, rows, width, reset):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], "k int, snap long, c long")
    got = counter_delta(df, ["k"], "snap", ["c"], reset, chunk=F.floor(F.col("snap") / width))
    assert {(r.k, r.snap): r.c for r in got.collect()} == _reference(rows, reset)


def _expr(draw, depth):
    kind = draw(st.integers(0, 3 if depth < 4 else 0))
    if kind == 0:
        return draw(st.sampled_from(["a", "b1", "x.y", "'s'", "42"]))
    if kind == 1:
        return f"NVL({_expr(draw, depth + 1)}, {_expr(draw, depth + 1)})"
    if kind == 2:
        n = draw(st.integers(1, 3))
        name = draw(st.sampled_from(["f", "GET_X", "substr", "nvl2"]))
        return f"{name}(" + ", ".join(_expr(draw, depth + 1) for _ in range(n)) + ")"
    return f"({_expr(draw, depth + 1)})"


@st.composite
def statements(draw):
    parts = [_expr(draw, 0) for _ in range(draw(st.integers(1, 3)))]
    return "SELECT " + ", ".join(parts) + " FROM t"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(statements(), min_size=1, max_size=6), chunk=st.sampled_from([None, 2, 3, 7]))
def test_call_argument_scan_matches_brute_force(spark, texts, chunk):
    """Plain windows and the chunked scans (tiny chunks force many chunks per text) agree with brute force."""
    from tempolens.operators.textscan import call_argument_scan
    from test_operators import _scan_brute
    df = spark.createDataFrame(list(enumerate(texts)), "id int, txt string")
    got = {}
    for r in call_argument_scan(df, "id", "txt", chunk=chunk).collect():
        got.setdefault(r.id, []).append((r.call_no, r.open_bracket_position, r.call_parameter))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == _scan_brute(t), (t, chunk)
