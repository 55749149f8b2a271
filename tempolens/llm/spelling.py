"""Spelling variants by k-d trees over letter counts.

One edit changes the letter counts of a word by at most one up and one down, so
by a distance of at most two.  The words of each length are dealt to the leaves
of a k-d tree over their letter counts; a word asks the leaves of its length and
of the next one whose boxes lie within one edit.  In a leaf a finer tree prunes
again, and what is left is verified letter by letter.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, kept, materialize

RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Dimensions: the letters a to z, then six that the other letters share (sharing only brings words nearer).
DIMS = 32
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])


def count_words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, typo_every: int | None = None) -> DataFrame:
    """(word, n): words of at least ``least_chars`` letters found at least ``least_n`` times.

    With ``typo_every`` (as a test of the grouping) an occurrence loses the letter
    h % length where that number divides h, the crc32 of ``<doc_id>:<word>``.
    Defined cases: a null or empty text has no words; a null id counts as an empty
    one; repeated rows count again; other columns are not read.
    """
    lower = F.translate("text", _UPPER, _LOWER)
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if typo_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % typo_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return (words.select(word.alias("word")).where(F.length("word") >= least_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n))


def letters(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row, and where each word begins (one more for the end)."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    return np.frombuffer(b"".join(raw), np.uint8), at


def letter_counts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    rows = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(rows * DIMS + _DIM[flat], minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def marks(counts: np.ndarray) -> np.ndarray:
    """Two bits for each dimension (one or more, two or more): bits that differ are at most the distance."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


@dataclass
class Node:
    """A box; inner nodes send counts of ``dim`` up to ``value`` to the left."""

    leaf: int = -1
    dim: int = -1
    value: int = -1
    left: Node | None = None
    right: Node | None = None


def grow(counts: np.ndarray, share: float, number: Iterator[int], rows: np.ndarray | None = None, order: list[np.ndarray] | None = None) -> Node:
    """A tree whose leaves hold at most ``share`` rows, where a split leaves rows on both sides; ``order`` gets the leaves' rows."""
    rows = np.arange(len(counts)) if rows is None else rows
    if len(rows) > max(share, 1):
        x = counts[rows]
        top = int(min(x.max(), 4))
        parts = np.stack([(x <= v).mean(axis=0) for v in range(max(top, 1))])
        gap = np.where((parts > 0) & (parts < 1), np.abs(parts - 0.5), 1)
        v, d = divmod(int(gap.argmin()), DIMS)
        if gap[v, d] == 1 and (spread := np.ptp(x, axis=0)).max() > 0:  # all differences are in high counts
            d = int(spread.argmax())
            v = (int(x[:, d].max()) + int(x[:, d].min())) // 2
        low = x[:, d] <= v
        if 0 < low.sum() < len(rows):
            return Node(-1, d, v, grow(counts, share, number, rows[low], order), grow(counts, share, number, rows[~low], order))
    if order is not None:
        order.append(rows)
    return Node(next(number))


def home(node: Node, counts: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(counts), np.int64)
    stack = [(node, np.arange(len(counts)))]
    while stack:
        at, rows = stack.pop()
        if at.leaf >= 0:
            out[rows] = at.leaf
        else:
            low = counts[rows, at.dim] <= at.value
            stack += [(at.left, rows[low]), (at.right, rows[~low])]
    return out


def within(node: Node, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows): rows whose counts reach the leaf's box with at most ``up`` letters more and ``down`` letters less."""
    n = len(counts)
    stack = [(node, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {}, {})]
    while stack:
        at, rows, more, less, lo, hi = stack.pop()
        if not len(rows):
            continue
        if at.leaf >= 0:
            yield at.leaf, rows
            continue
        c, d, v = counts[rows, at.dim], at.dim, at.value
        # the counts to give up or add for this dimension, over what its box asked before
        fewer = less + np.maximum(c - v, 0) - (np.maximum(c - hi[d], 0) if d in hi else 0)
        ok = fewer <= down
        stack.append((at.left, rows[ok], more[ok], fewer[ok], lo, hi | {d: v}))
        added = more + np.maximum(v + 1 - c, 0) - (np.maximum(lo[d] - c, 0) if d in lo else 0)
        ok = added <= up
        stack.append((at.right, rows[ok], added[ok], less[ok], lo | {d: v + 1}, hi))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter or, where ``long`` has one more, one inserted letter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


class Leaf:
    """The words of a leaf (all of one length) under a tree of their own."""

    def __init__(self, words: pa.Array, n: np.ndarray, leaf: int, bucket: int = 24):
        flat, at = letters(words)
        self.length = int(at[1]) if len(n) else 0
        text = flat.reshape(len(n), self.length)
        counts = letter_counts(flat, at)
        order: list[np.ndarray] = []
        self.tree = grow(counts, bucket, itertools.count(), order=order)
        self.at = np.concatenate([[0], np.cumsum([len(o) for o in order])])
        self.order = np.concatenate(order)
        self.leaf, self.words, self.n, self.text, self.mark = leaf, words, n[self.order], text[self.order], marks(counts)[self.order]
        self.rank = np.unique(self.text, axis=0, return_inverse=True)[1].ravel() if len(n) else self.order

    def near(self, words: pa.Array, n: np.ndarray, home_leaf: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What words of this length or one letter shorter find here, told for both words of each pair."""
        flat, at = letters(words)
        lens = np.diff(at)
        counts, mark = letter_counts(flat, at), marks(letter_counts(flat, at))
        for size, up, down in ((self.length, 1, 1), (self.length - 1, 1, 0)):
            own = np.flatnonzero(lens == size)
            if not len(own):
                continue
            text = flat[at[own][:, None] + np.arange(size)]
            reached = within(self.tree, counts[own], up, down)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            found = 0
            for leaf, rows in reached:
                s, e = self.at[leaf], self.at[leaf + 1]
                for k in range(0, len(rows), 20_000):
                    some = rows[k:k + 20_000]
                    i, j = np.nonzero(np.bitwise_count(mark[own[some]][:, None] ^ self.mark[None, s:e]) <= up + down)
                    i, j = some[i], j + s
                    step = max(1, 8_000_000 // (size + 1))
                    for m in range(0, len(i), step):
                        x, y = i[m:m + step], j[m:m + step]
                        ok = one_edit(text[x], self.text[y])
                        pairs.append((x[ok], y[ok]))
                        found += int(ok.sum())
                if found > 500_000:
                    yield from self._told(words, n, home_leaf, own, size, text, pairs)
                    pairs, found = [], 0
            yield from self._told(words, n, home_leaf, own, size, text, pairs)

    def _told(self, words: pa.Array, n: np.ndarray, home_leaf: np.ndarray, own: np.ndarray, size: int, text: np.ndarray,
              pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not pairs:
            return
        i, j = (np.concatenate(x) for x in zip(*pairs))
        if size == self.length:  # a pair of one leaf is met from both sides: the smaller word tells
            both = home_leaf[own[i]] == self.leaf
            first = (text[i] != self.text[j]).argmax(axis=1)
            row = np.arange(len(i))
            ok = ~both | (text[i][row, first] < self.text[j][row, first])
            i, j = i[ok], j[ok]
        if not len(i):
            return
        q = own[i]
        names, here = words.take(pa.array(q)), self.words.take(pa.array(self.order[j]))
        rank = np.unique(text, axis=0, return_inverse=True)[1].ravel()[i]
        yield tell(names, q, here, self.n[j], self.rank[j])
        yield tell(here, j, names, n[q], rank)


def tell(words: pa.Array, of: np.ndarray, others: pa.Array, n: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """For each word the number of its partners, and the one of largest n (then the smallest)."""
    order = np.lexsort((rank, -n, of))
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    best = pa.array(order[first])
    return pa.RecordBatch.from_arrays(
        [words.take(best), pa.array(np.diff(np.r_[first, len(of)]).astype(np.int64)), pa.array(n[order[first]]), others.take(best)],
        ["word", "n_near", "best_n", "best"])


def partition_trees(words: DataFrame, leaf_words: int, sample_words: int) -> dict[int, Node]:
    """A tree for each length, fit on about ``sample_words`` words in all; only where words go depends on it."""
    size = F.length("word").alias("size")
    sizes = {r["size"]: r["n"] for r in words.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    rate = min(1.0, sample_words / max(total, 1))
    limits = {k: max(16, min(leaf_words, 4_194_304 // k)) for k in sizes}
    large = [k for k in sizes if sizes[k] > limits[k]]
    trees = {k: Node(0) for k in sizes}
    if large:
        draw = F.pmod(F.xxhash64("word"), F.lit(1_000_003)) < F.lit(int(1_000_003 * rate) or 1)
        got = words.where(F.length("word").isin(large) & draw).select("word").toArrow().column("word").combine_chunks()
        flat, at = letters(got)
        lens, counts = np.diff(at), letter_counts(flat, at)
        for k in large:
            x = counts[lens == k]
            if len(x):
                trees[k] = grow(x, max(8, limits[k] / sizes[k] * len(x)), itertools.count())
    return trees


def near_words(words: DataFrame, leaf_words: int = 8192, sample_words: int = 100_000) -> DataFrame:
    """(word, n_near, best_n, best) for the words of (word, n) that have a word one edit away.

    A task gets the words of a leaf, in parts of about ``leaf_words`` where their
    counts cannot be split, and reads the words that ask it as a stream.
    """
    spark = words.sparkSession
    trees = partition_trees(words, leaf_words, sample_words)
    sent = spark.sparkContext.broadcast(trees)
    name = f"spelling trees {uuid.uuid4().hex}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = kept(name, lambda: sent.value)
        for b in batches:
            flat, at = letters(b.column("word"))
            lens, counts = np.diff(at), letter_counts(flat, at)
            for size in np.unique(lens).tolist():
                own = np.flatnonzero(lens == size)
                some, x = b.take(pa.array(own)), counts[own]
                mine = home(trees[size], x)

                def out(rows: np.ndarray, length: int, leaf: int | np.ndarray, role: int) -> pa.RecordBatch:
                    at_leaf = np.full(len(rows), leaf) if isinstance(leaf, int) else leaf
                    got = some.take(pa.array(rows))
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), length, np.int32)), pa.array(at_leaf), pa.array(np.full(len(rows), role, np.int32)),
                         got.column("word"), got.column("n"), pa.array(mine[rows])], ["length", "leaf", "role", "word", "n", "home"])

                yield out(np.arange(len(own)), size, mine, 0)
                for leaf, rows in within(trees[size], x, 1, 1):
                    if len(rows := rows[mine[rows] <= leaf]):  # the other leaf asks this one otherwise
                        yield out(rows, size, leaf, 1)
                if size + 1 in trees:
                    for leaf, rows in within(trees[size + 1], x, 1, 0):
                        yield out(rows, size + 1, leaf, 1)

    kind = "length int, leaf long, role int, word string, n long, home long"
    points = words.mapInArrow(deal, kind).where("role = 0").groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("points"))
    big = {(r["length"], r["leaf"]): -(-r["points"] // (2 * leaf_words)) for r in points.where(F.col("points") > 2 * leaf_words).collect()}
    dealt = words.mapInArrow(deal, kind).withColumn("part", F.lit(0).cast("long"))
    if big:
        split = F.broadcast(spark.createDataFrame([(*k, v) for k, v in big.items()], "length int, leaf long, parts long"))
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        spread = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
        dealt = dealt.drop("part").join(split, ["length", "leaf"], "left").withColumn("part", F.explode(spread)).drop("parts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, asks, leaf = None, [], [], None

        def answer() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(asks).combine_chunks()
            asks.clear()
            yield from leaf.near(t.column("word").combine_chunks(), t.column("n").to_numpy(), t.column("home").to_numpy())

        for b in batches:
            cols = [b.column(k).to_numpy() for k in ("length", "leaf", "part", "role")]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for s, e in itertools.pairwise([0, *cut.tolist(), b.num_rows]):
                if s == e:
                    continue
                now, rows = tuple(int(c[s]) for c in cols[:3]), b.slice(s, e - s)
                if now != key:
                    if asks:
                        yield from answer()
                    key, points, leaf = now, [], None
                if cols[3][s] == 0:
                    points.append(rows)
                    continue
                if not points and leaf is None:
                    continue  # a box that holds no word
                if leaf is None:
                    t = pa.Table.from_batches(points).combine_chunks()
                    points = []
                    leaf = Leaf(t.column("word").combine_chunks(), t.column("n").to_numpy(), key[1])
                asks.append(rows)
                if sum(map(len, asks)) >= 40_000:
                    yield from answer()
        if asks:
            yield from answer()

    found = (dealt.repartition("length", "leaf", "part").sortWithinPartitions("length", "leaf", "part", "role")
             .mapInArrow(search, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(words: DataFrame, times: int = 2, leaf_words: int = 8192, sample_words: int = 100_000) -> DataFrame:
    """``words`` (word, n) plus n_near, form, form_n and root.

    n_near counts the words one inserted, deleted or replaced letter away.  form is
    the one of largest n (ties: the smallest), if its n is ``times`` this word's n or
    more; root is the end of the chain of forms.  As n grows by ``times`` with each
    form, chains are short and their ends found by doubling.

    Defined cases: words are distinct, of letters up to U+00FF, with n of 1 or more;
    a word without near words has n_near 0, no form, and is its own root; an empty
    table gives an empty result; other columns are not carried.
    """
    src = materialize(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and word <> ''"), "words")
    near = near_words(src, leaf_words, sample_words)
    w = near.withColumnRenamed("word", "__w")
    strong = F.col("best_n") >= times * F.col("n")
    out = materialize(src.join(w, F.col("word") == F.col("__w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    ends = materialize(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    most = out.agg(F.max("n")).first()[0] or 1
    links = max(1, math.ceil(math.log(most, times))) if times > 1 else most
    for _ in range(max(0, math.ceil(math.log2(links)))):
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("__root"))
        new = materialize(ends.join(up, "root", "left").select("word", F.coalesce("__root", "root").alias("root")), "roots")
        drop_table(ends)
        ends = new
    return out.join(ends.withColumnRenamed("word", "__w"), F.col("word") == F.col("__w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
