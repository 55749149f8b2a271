import re

import pytest
from pyspark.sql import functions as F

from tempolens.llm import ngram_join as J
from tempolens.llm.queries import op5_ngram_jaccard_join

from .helpers import ROWS, frame, got, save

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = ("doc_id", "n_shingles", "component_id")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4, percent=85):
    """Every pair that shares a shingle, by an index of all shingles."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    same_id = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
        if s and rows[i][0] is not None:
            j = same_id.setdefault(rows[i][0], i)
            root[find(i)] = find(j)
    common = {}
    for i, s in enumerate(sets):
        count = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, o in count.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                root[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            common.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min(common[find(i)]) if s and find(i) in common else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(d != c for d, _, c in want)
    assert got(op5_ngram_jaccard_join(spark, sf), *COLS) == want


def family():
    """Near copies of one text at many similarities around the threshold, and texts that share a passage."""
    import random
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    base = [rnd.choice(vocab) for _ in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        rows.append((1000 - i, " ".join(w)))
    passage = " ".join(base[10:40])
    rows += [(2000 + i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))) + " " + passage) for i in range(60)]
    rows += [(3000 + i, " ".join(rnd.choice(vocab[:3]) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    return rows


@pytest.mark.parametrize("hot_share,max_hot", [(0.002, 200_000), (0.3, 50), (2.0, 10)])
def test_families_for_any_choice_of_frequent_grams(spark, hot_share, max_hot):
    rows = family()
    out = J.similar_documents(frame(spark, rows).repartition(4), 4, 85, hot_share=hot_share, max_hot=max_hot, bucket_grams=500)
    assert got(out, *COLS) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    rows = family()
    whole, groups = J.unconnected, J.link_groups
    monkeypatch.setattr(J, "unconnected", lambda *a: whole(*a, block=16))
    monkeypatch.setattr(J, "link_groups", lambda *a: groups(*a, block=12))
    monkeypatch.setattr(J, "BROADCAST_KEYS", 0)
    assert got(J.similar_documents(frame(spark, rows), 3, 80), *COLS) == brute(rows, 3, 80)


def test_edges(spark, tmp_path):
    docs = frame(spark).selectExpr("*", "1 as id", "2 as key", "'x' as gram", "3 as n_shingles")
    assert got(op5_ngram_jaccard_join(spark, save(tmp_path, documents=docs)), *COLS) == brute(ROWS)
    assert J.similar_documents(frame(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f"), (3, "A b  c d e f"), (9, None), (9, None), (4, "q"), (8, "other words here"), (8, "other words here"), (None, "q")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "1 as rk", "2 as id")
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    assert got(out, "doc_id", "text") == sorted([rows[1], rows[2], rows[3], rows[4], rows[5], rows[6]], key=repr)


def test_parities_bound_the_overlap(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    rows, want = [], []
    for i in range(300):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        keep = rnd.random(len(a)) < rnd.choice([0.0, 0.7, 0.95, 1.0])
        b = np.unique(np.concatenate([a[keep], rnd.integers(0, 1 << 63, max(1, int(len(a) * rnd.choice([0.0, 0.1, 0.4])))).astype(np.uint64)]))
        rows.append((i, J.parities(a).tolist(), J.parities(b).tolist()))
        want.append(len(np.setxor1d(a, b)))
        assert max(65, 4 * len(a)) > len(rows[-1][1]) * 64 >= 2 * len(a)
    out = {r.i: r.d for r in spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
           .where("size(a) <= 2 * size(b) and size(b) <= 2 * size(a)").select("i", J.differing(F.col("a"), F.col("b")).alias("d")).collect()}
    assert out and all(d <= want[i] and (want[i] - d) % 2 == 0 for i, d in out.items())
    assert any(out[i] for i in out)


def test_long_and_short_texts_of_one_passage(spark):
    """Sizes over several widths of the parities."""
    import random
    rnd = random.Random(11)
    words = [f"u{i}" for i in range(60)]
    rows = []
    for i in range(70):
        base = [f"b{i % 7}_{k}" for k in range(40 + 60 * (i % 7))]
        for _ in range(rnd.choice([0, 1, 3, 6, 9])):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        rows.append((i, " ".join(base[:len(base) - rnd.choice([0, 0, 5])] + words[:20])))
    out = J.similar_documents(frame(spark, rows), 4, 85, hot_share=2.0)
    assert got(out, *COLS) == brute(rows)


def test_a_worker_holds_a_short_stretch():
    """Sets of one large batch and the n-grams being counted are not all held at once."""
    import random
    import tracemalloc

    import pyarrow as pa
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(500)) for _ in range(3000)]
    b = pa.RecordBatch.from_pydict({"id": range(3000), "rk": range(3000), "text": texts})
    J.gram_set(b"fill", 5)
    tracemalloc.start()
    rows = 0
    for out in J.described_rows(iter([b]), J.Jaccard(5, 80), 0.002):
        rows += out.num_rows - out.column("key").null_count
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000
    assert peak < 30_000_000
