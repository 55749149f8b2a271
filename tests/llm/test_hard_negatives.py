import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolens.llm import hard_negatives as H
from tempolens.llm.queries import op13_hard_negatives

from .helpers import frame, got, save

COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, relabel=True):
    """All scores as Python integers."""
    use = set()
    for v, e, g in rows:
        if v is not None and e is not None and g is not None and all(x is not None and math.isfinite(x) for x in e):
            use.add((v, (g + 1) % 10 if relabel and v % 7 == 0 else g, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    use = sorted(use)
    out = []
    for a in use:
        if a[0] % every:
            continue
        score = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in use if b != a))
        for s, p, _ in [x for x in score if x[2] == a[1]][:5]:
            fit = [x for x in score if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_embeddings(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op13_hard_negatives(spark, sf), *COLS) == brute(rows)


def clusters(n, d, seed=3):
    rnd = np.random.default_rng(seed)
    mid = rnd.normal(size=(9, d))
    return [(i * 5, [float(np.float32(x)) for x in mid[i % 9] + rnd.normal(size=d) * 0.3 * (i % 4)], i % 5) for i in range(n)]


ODD = [(None, [1.0, 2.0], 1), (100, None, 1), (200, [1.0], None), (300, [1.0, None], 2), (400, [float("nan")], 2), (500, [float("inf")], 2), (600, [], 3),
       (3, [0.5, 0.5], 3), (3, [0.5, 0.5], 3), (3, [0.25], 4), (700, [0.5, 0.5, 0.5, 1.0, 2.0, 3.0, 1.0], 3), (800, [0.0] * 6, 3)]


@pytest.mark.parametrize("size", [{}, {"cell_rows": 8, "part_rows": 7, "first_rows": 20, "anchor_block": 3}])
def test_small_cells_and_odd_rows(spark, tmp_path, size):
    rows = clusters(400, 6) + [(10_000 + i, [0.5] * 6, i % 2) for i in range(60)] + ODD
    df = frame(spark, rows, SCHEMA).repartition(5).selectExpr("*", "1 as rank", "2 as score", "3 as akey", "4 as q")
    out = H.hard_negatives(df, F.col("vec_id") % 100 == 0, **size)
    assert got(out, *COLS) == brute(rows, relabel=False)
    if not size:
        assert got(op13_hard_negatives(spark, save(tmp_path, embeddings=df)), *COLS) == brute(rows)


def test_empty(spark):
    for rows in ([], [(100, None, 1)], [(7, [1.0], 1)], [(100, [1.0], 1)]):
        assert H.hard_negatives(frame(spark, rows, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_cells_are_left_out():
    rnd = np.random.default_rng(5)
    x = np.floor(256 * (rnd.normal(size=(40, 8)) * 3)[rnd.integers(0, 40, 4000)] + 40 * rnd.normal(size=(4000, 8)))
    index = H.MultiIndex(8, (H.centres(x[:, :4], 8), H.centres(x[:, 4:], 8)))
    c1, r1, c2, r2 = index.codes(x)
    cell, inv = np.unique(c1 * 8 + c2, return_inverse=True)
    radii = np.zeros((len(cell), 2))
    np.maximum.at(radii[:, 0], inv, r1)
    np.maximum.at(radii[:, 1], inv, r2)
    index.set_cells(cell // 8, cell % 8, np.bincount(inv), radii, 100)
    left_out = 0
    for a in x[:50]:
        bounds = list(index.visit(a))
        assert sorted(c for _, c in bounds) == list(range(len(cell)))
        assert all(p[0] >= q[0] for p, q in zip(bounds, bounds[1:]))
        assert all((H.products(a[None], x[inv == c])[0] <= b + 1e-3).all() for b, c in bounds)
        none = np.array([-np.inf])
        first = index.plan(a, none, -none, None, 300)
        floor = np.sort(H.products(a[None], x[np.isin(inv, first)])[0])[-5:-4].astype(float)
        rest = index.plan(a, none, -none, floor, 300)
        assert not set(first) & set(rest)
        read = np.isin(inv, first + rest)
        assert H.products(a[None], x[~read])[0].max(initial=-2**60) < floor[0]
        left_out += (~read).sum()
    assert left_out > 0


def test_exact_products():
    a = np.array([[2.0 ** 26 - 1, 3.0]])
    assert H.products(a, a)[0, 0] == (2**26 - 1) ** 2 + 9
    big = np.array([[2.0 ** 27 - 1, 1.0]])
    assert H.products(big, big)[0, 0] == (2**27 - 1) ** 2 + 1
