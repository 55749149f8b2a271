import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempolens.llm import spelling as S
from tempolens.llm.queries import op12_spelling_variants

from .helpers import LONG, ROWS, frame, got, save

COLS = ("word", "n", "n_near", "form", "form_n", "root")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(ASCII)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edits(w, letters):
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1:]
        for c in letters:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1:]


def brute(n):
    """Every word one edit away is made and looked up."""
    letters = sorted({c for w in n for c in w})
    form, out = {}, []
    near = {w: {x for x in edits(w, letters) if x in n and x != w} if len(w) < 200 else set() for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out, key=repr)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(brute_words(rows))
    assert len(want) > 2000 and any(r[3] != r[5] and r[3] for r in want)
    assert got(op12_spelling_variants(spark, sf), *COLS) == want


WORDS = "colour color colours Colour COLOR theatre theater naïve naive naïves straße strasse grüße abcde abcdé bacde acbde edcba abcdef abcdeff"
TEXTS = [(i, " ".join(w for k, w in enumerate(WORDS.split()) if i % (k % 5 + 1) == 0)) for i in range(40)] + [(None, "colour; ab×cd÷ Ünder_Ünder-Ünder"), *ROWS]


def test_odd_rows(spark, tmp_path):
    df = frame(spark, TEXTS).selectExpr("*", "1 as word", "2 as n", "3 as root")
    assert got(op12_spelling_variants(spark, save(tmp_path, documents=df)), *COLS) == brute(brute_words(TEXTS))
    assert op12_spelling_variants(spark, save(tmp_path / "e", documents=frame(spark, []))).count() == 0
    assert LONG


@pytest.mark.parametrize("leaf_words", [4, 30])
def test_many_leaves(spark, leaf_words):
    rnd = np.random.default_rng(leaf_words)
    n = {}
    for _ in range(900):
        n["".join(rnd.choice(list("aabcdeéÿ"), rnd.integers(1, 8)))] = int(rnd.integers(1, 200))
    n |= {"".join(p): 3 + k for k, p in enumerate({tuple(rnd.permutation(list("abcdefg"))) for _ in range(120)})}  # equal counts: no split
    n |= {"z" * 3000: 5, "z" * 3001: 50, "z" * 3003: 7, "z" * 2999 + "y": 1}
    want = brute(n)
    long = {"z" * 3000: (2, "z" * 3001), "z" * 3001: (1, None), "z" * 2999 + "y": (1, "z" * 3000)}
    got_rows = got(S.spelling_variants(frame(spark, list(n.items()), "word string, n long"), leaf_words=leaf_words, sample_words=400), *COLS)
    assert [r for r in got_rows if len(r[0]) < 200] == [r for r in want if len(r[0]) < 200]
    for w, (k, form) in long.items():
        assert [(r[2], r[3]) for r in got_rows if r[0] == w] == [(k, form)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=2, max_size=60, unique=True), st.integers(1, 8))
def test_trees_lose_no_pair(words, share):
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    seen = set()
    for size, some in by.items():
        flat, at = S.letters(pa.array(some))
        counts = S.letter_counts(flat, at)
        tree = S.grow(counts, share, iter(range(10**6)))
        homes = S.home(tree, counts)
        for ask, up, down in ((some, 1, 1), (by.get(size - 1, []), 1, 0)):
            if ask:
                for leaf, rows in S.within(tree, S.letter_counts(*S.letters(pa.array(ask))), up, down):
                    seen |= {(ask[r], x) for r in rows for x, h in zip(some, homes) if h == leaf}
    for w in words:
        for x in set(edits(w, "abcé")) & set(words) - {w}:
            if len(w) <= len(x):
                assert (w, x) in seen
                a, b = (np.frombuffer(y.encode("latin-1"), np.uint8)[None] for y in (w, x))
                assert S.one_edit(a, b)[0]
                m = [S.marks(S.letter_counts(*S.letters(pa.array([y]))))[0] for y in (w, x)]
                assert np.bitwise_count(m[0] ^ m[1]) <= 2


def test_one_edit_only():
    for a, b, yes in (("abc", "abd", True), ("abc", "acb", False), ("abc", "abcc", True), ("abc", "xabc", True), ("abc", "bacc", False), ("aab", "aaab", True)):
        x, y = (np.frombuffer(s.encode(), np.uint8)[None] for s in (a, b))
        assert bool(S.one_edit(x, y)[0]) is yes
