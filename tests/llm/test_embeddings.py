import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempolens.llm import embeddings as E
from tempolens.llm.components import connected_components
from tempolens.llm.queries import op1_embedding_near_dedup

from .helpers import frame, got, save

COLS = ("vec_id", "n_links", "component_id", "kept")


def brute(rows, threshold=0.98):
    """All pairs in double precision."""
    ok = [i for i, (v, e, g) in enumerate(rows) if v is not None and g is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for i in ok:
        root[find(i)] = find(first.setdefault(rows[i][0], i))
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (i, j))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    names = {}
    for i in ok:
        names[find(i)] = min(names.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (v, _, _) in enumerate(rows):
        c = names[find(i)] if i in ok else v
        out.append((v, links[i], c, v == c))
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_embeddings(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert got(op1_embedding_near_dedup(spark, sf), *COLS) == want


def near(n, d=24, seed=1):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, d))
    return [(int(i * 7 % 1009), [float(np.float32(x)) for x in centers[i % 6] + rnd.normal(size=d) * (0.02 + 0.2 * (i % 5))], i % 3) for i in range(n)]


ODD = [(2000, None, 1), (2001, [1.0, 2.0], None), (2002, [0.0, 0.0], 1), (2003, [1.0, None], 1), (2004, [float("nan"), 1.0], 1), (2005, [float("inf"), 1.0], 1),
       (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (2009, [1.0, 2.0, 0.0], 1), (None, [1.0, 2.0], 1), (2010, [1e-30, 2e-30], 1),
       (2011, [1e38, 2e38], 1), (2007, [1.0, 2.0], 1), (2012, [-1.0, -2.0], 1), (2013, [5.0], 1), (2014, [0.1], 1), (2015, [-0.0, 1.0], 2), (2016, [0.0, 1.0], 2)]


@pytest.mark.parametrize("block", [16, 4096])
def test_blocks_and_edges(spark, tmp_path, block):
    rows = near(220) + ODD
    df = frame(spark, rows, SCHEMA).repartition(4).selectExpr("*", "1 as rep", "2 as n_links", "3 as n")
    assert got(E.link_vectors(df, block=block), *COLS) == brute(rows)
    if block == 16:
        assert got(op1_embedding_near_dedup(spark, save(tmp_path, embeddings=df)), *COLS) == brute(rows)


def test_empty(spark):
    assert E.link_vectors(frame(spark, [], SCHEMA)).count() == 0
    only_odd = frame(spark, [(1, None, None), (2, [0.0], 3)], SCHEMA)
    assert got(E.link_vectors(only_odd), *COLS) == [(1, 0, 1, True), (2, 0, 2, True)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([2, 5, 64, 1500]), st.floats(0.5, 0.999))
def test_no_pair_is_lost(seed, n, d, threshold):
    rnd = np.random.default_rng(seed)
    a = rnd.normal(size=(n, d)) + 3 * rnd.normal(size=d)
    b = a[rnd.permutation(n)] + rnd.normal(size=(n, d)) * rnd.choice([0.0, 0.1, 0.5])
    cos = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(cos >= threshold))}
    sure = {(i, j) for i, j in want if abs(cos[i, j] - threshold) > 1e-12}
    found = {(int(x), int(y)) for i, j in E.linked_pairs(a, b, threshold, slab=7) for x, y in zip(i, j)}
    assert sure <= found and all(cos[i, j] >= threshold - 1e-12 for i, j in found)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    out = {r.node: r.component for r in connected_components(frame(spark, pairs, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert out == {x: find(x) for x in root}


def test_long_chain(spark):
    chain = frame(spark, [(i, i + 1) for i in range(300)], "u long, v long")
    assert {tuple(r) for r in connected_components(chain).collect()} == {(i, 0) for i in range(301)}
