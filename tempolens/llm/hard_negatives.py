"""Hard negatives by an inverted multi-index.

Two codebooks, one for each half of the components, put every vector in a cell.
An anchor visits the cells in the order of a multi-sequence heap, by the sum of
the two half-score bounds (product with the centre plus norm times radius), and
stops once no cell left can change one of its score windows.  Scores are exact
integers, so the index decides only what is read, never the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Scores stay below this, so a hundred times a score fits a long.
_LARGEST = 2.0 ** 56
_FOUND = "akey long, anchor_id long, w int, rkey long, vec_id long, score long"


def whole_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q, rkey): components as ``floor(scale * x)``, one row for each distinct one."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    size = F.greatest(F.size(v), F.lit(1)).cast("double")
    small = F.forall(v, lambda x: F.abs(x.cast("double") * scale) < F.sqrt(F.lit(_LARGEST) / size) - 1)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & small, F.lit(False))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(usable)
            .select("vec_id", F.xxhash64("label").alias("label"), q.alias("q"))
            .withColumn("rkey", F.xxhash64("vec_id", "label", "q")).dropDuplicates(["vec_id", "rkey"]))


def matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out = np.zeros((len(col), dims))
    lens = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(col)), lens)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lens) - lens, lens)] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``k`` centres (fewer if there are fewer distinct rows) by Lloyd's rounds."""
    x = np.unique(x, axis=0) if x.shape[1] else x[:1]
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(axis=1) - 2 * x[s:s + 4096] @ c.T).argmin(axis=1) for s in range(0, max(len(x), 1), 4096)])


@dataclass
class MultiIndex:
    """Codebooks of the halves, and for each used cell its rows, parts and radii."""

    dims: int
    books: tuple[np.ndarray, np.ndarray]
    grid: np.ndarray | None = None  # by the two codes the number of the cell, -1 if it is empty
    rows: np.ndarray | None = None
    parts: np.ndarray | None = None
    radii: np.ndarray | None = None  # of the cells' halves

    @property
    def half(self) -> int:
        return self.dims // 2

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for part, book in zip((x[:, :self.half], x[:, self.half:]), self.books):
            at = nearest(part, book)
            out += [at, np.linalg.norm(part - book[at], axis=1) * (1 + 1e-9)]
        return tuple(out)

    def set_cells(self, c1: np.ndarray, c2: np.ndarray, n: np.ndarray, radii: np.ndarray, part_rows: int) -> None:
        self.grid = np.full((len(self.books[0]), len(self.books[1])), -1)
        self.grid[c1, c2] = np.arange(len(c1))
        self.rows, self.radii, self.parts = n, radii, np.ceil(n / part_rows).astype(np.int64)
        self.code = np.stack([c1, c2], axis=1)

    def visit(self, a: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) with the bounds falling; each is at least the score of ``a`` with any row of this or a later cell."""
        halves = (a[:self.half], a[self.half:])
        sums = []
        for h, (part, book) in enumerate(zip(halves, self.books)):
            widest = np.zeros(len(book))
            np.maximum.at(widest, self.code[:, h], self.radii[:, h])
            s = book @ part + np.linalg.norm(part) * widest
            sums.append((np.argsort(-s, kind="stable"), np.sort(-s, kind="stable")))
        (o1, s1), (o2, s2) = sums
        heap = [(s1[0] + s2[0], 0, 0)]
        while heap:
            b, i, j = heapq.heappop(heap)
            if self.grid[o1[i], o2[j]] >= 0:
                yield -b, int(self.grid[o1[i], o2[j]])
            if j + 1 < len(o2):
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))

    def plan(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray | None, first_rows: int) -> list[int]:
        """Cells to read for the windows [low, high] of scores.

        Without ``floor`` the first cells, up to about ``first_rows`` rows.  With it
        (the least score of each window that can still change its result) all the
        cells after these that the windows need; what is not read is certified.
        """
        mid = self.books[0][self.code[:, 0]] @ a[:self.half] + self.books[1][self.code[:, 1]] @ a[self.half:]
        wide = np.linalg.norm(a[:self.half]) * self.radii[:, 0] + np.linalg.norm(a[self.half:]) * self.radii[:, 1]
        slack = 1e-6 * (1 + np.abs(mid) + wide)
        top, bottom = mid + wide + slack, mid - wide - slack
        out, seen = [], 0
        for bound, cell in self.visit(a):
            if bound + 1e-6 * (1 + abs(bound)) < (low if floor is None else floor).min():
                break
            if not ((top[cell] >= low) & (bottom[cell] <= high)).any():
                continue
            head = seen < first_rows
            seen += int(self.rows[cell])
            if floor is None:
                if not head:
                    break
                out.append(cell)
            elif not head and ((top[cell] >= floor) & (bottom[cell] <= high)).any():
                out.append(cell)
        return out


def fit_index(rows: DataFrame, n: int, dims: int, cell_rows: int = 1024, max_codes: int = 256, sample_rows: int = 20_000) -> MultiIndex:
    """Codebooks fit on about ``sample_rows`` rows, chosen by a hash; at most ``max_codes`` centres a half, about ``cell_rows`` rows a cell."""
    k = max(1, min(max_codes, math.isqrt(n // cell_rows)))
    draw = F.pmod(F.xxhash64("rkey", "vec_id"), F.lit(1_000_003)) < F.lit(max(1, int(1_000_003 * min(1.0, sample_rows / n))))
    x = matrix(rows.where(draw).select("q").toArrow().column("q"), dims)
    x = x if len(x) else np.zeros((1, dims))
    return MultiIndex(dims, (centres(x[:, :dims // 2], k), centres(x[:, dims // 2:], k)))


def index_rows(rows: DataFrame, index: MultiIndex, part_rows: int) -> DataFrame:
    """``rows`` with their cell and part, written; the cells' sizes and radii go into ``index`` (at most max_codes squared of them)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(MultiIndex(index.dims, index.books))

    @F.arrow_udf("c1 int, c2 int, r1 double, r2 double")
    def assign(q: pa.Array) -> pa.Array:
        c1, r1, c2, r2 = sent.value.codes(matrix(q, sent.value.dims))
        return pa.StructArray.from_arrays([pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(r1), pa.array(r2)], ["c1", "c2", "r1", "r2"])

    coded = materialize(rows.withColumn("code", assign("q")).select("vec_id", "label", "q", "rkey", "code.*"), "codes")
    cells = coded.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("c1", "c2").toArrow()
    c1, c2, n, r1, r2 = (cells.column(k).to_numpy() for k in ("c1", "c2", "n", "r1", "r2"))
    index.set_cells(c1, c2, n, np.stack([r1, r2], axis=1), part_rows)
    split = spark.createDataFrame(pa.table({"c1": c1, "c2": c2, "cell": np.arange(len(n)), "parts": index.parts}))
    return materialize(coded.join(F.broadcast(split), ["c1", "c2"]).select(
        "vec_id", "label", "q", "rkey", "cell", F.pmod(F.xxhash64("rkey", "vec_id"), F.col("parts")).alias("part")), "cells")


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-number rows."""
    top = max(np.abs(a).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * max(a.shape[1], 1)
    return (a @ x.T).astype(np.int64) if top < 2.0 ** 53 else a.astype(np.int64) @ x.astype(np.int64).T


def search(anchors: DataFrame, rows: DataFrame, index: MultiIndex, same: bool, keep: int, second: bool, first_rows: int, blocks: int) -> DataFrame:
    """The best ``keep`` rows of the anchors' label (``same``) or of other labels, by window, among the cells read in this round.

    ``anchors``: akey, vec_id, label, q, and arrays w, low, high, floor of their
    windows.  A task holds one part of a cell and one block of anchors.
    """
    sent = anchors.sparkSession.sparkContext.broadcast(index)
    kind = "cell long, part long, ab long, akey long, anchor_id long, alabel long, aq array<int>, w array<int>, low array<double>, high array<double>"

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            a = matrix(b.column("q"), ix.dims)
            lists = [b.column(k).to_pylist() for k in ("low", "high", "floor")]
            at, cell, part = [], [], []
            for i in range(len(a)):
                low, high, floor = (np.array(x[i], float) for x in lists)
                for c in ix.plan(a[i], low, high, floor if second else None, first_rows):
                    for p in range(int(ix.parts[c])):
                        at.append(i)
                        cell.append(c)
                        part.append(p)
                if len(at) >= 2000 or i + 1 == len(a):
                    own = b.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int64()), pa.array(part, pa.int64()), *[own.column(k) for k in ("ab", "akey", "vec_id", "label", "q", "w", "low", "high")]],
                        ["cell", "part", "ab", "akey", "anchor_id", "alabel", "aq", "w", "low", "high"])
                    at, cell, part = [], [], []

    reads = materialize(anchors.withColumn("ab", F.pmod(F.xxhash64("akey", "vec_id"), F.lit(blocks).cast("long"))).mapInArrow(plan, kind), "reads")
    tiles = reads.select("cell", "part", "ab").distinct()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ix = sent.value
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            ids, rkeys, labels = (right.column(k).to_numpy() for k in ("vec_id", "rkey", "label"))
            order = np.lexsort((rkeys, ids))
            ids, rkeys, labels = ids[order], rkeys[order], labels[order]
            x = matrix(right.column("q"), ix.dims)[order]
            akeys, aids, alabels = (left.column(k).to_numpy() for k in ("akey", "anchor_id", "alabel"))
            ws, lows, highs = (left.column(k).to_pylist() for k in ("w", "low", "high"))
            for s in range(0, left.num_rows, 256):
                scores = products(matrix(left.column("aq").slice(s, 256), ix.dims), x)
                for i in range(len(scores)):
                    k = s + i
                    fit = np.flatnonzero((labels == alabels[k]) & ((rkeys != akeys[k]) | (ids != aids[k])) if same else labels != alabels[k])
                    mine = scores[i][fit]
                    for w, low, high in zip(ws[k], lows[k], highs[k]):
                        inside = (mine >= low) & (mine <= high)
                        got, val = fit[inside], mine[inside]
                        if len(val) > keep:
                            tall = val >= np.partition(val, len(val) - keep)[len(val) - keep]
                            got, val = got[tall], val[tall]
                            best = np.lexsort((got, -val))[:keep]
                            got, val = got[best], val[best]
                        for o, v in zip(out, (np.full(len(got), akeys[k]), np.full(len(got), aids[k]), np.full(len(got), w, np.int32), rkeys[got], ids[got], val)):
                            o.append(v)
        names = ("akey", "anchor_id", "w", "rkey", "vec_id", "score")
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, np.int32 if n == "w" else np.int64) for n, o in zip(names, out)})

    tiles = tiles.select(F.col("cell").alias("tcell"), F.col("part").alias("tpart"), F.col("ab").alias("tab"))
    right = rows.join(tiles, (F.col("cell") == F.col("tcell")) & (F.col("part") == F.col("tpart"))).select(
        *[F.col(k).alias(f"r_{k}") for k in ("cell", "part")], F.col("tab").alias("r_ab"), "vec_id", "label", "q", "rkey")
    found = reads.groupBy("cell", "part", "ab").cogroup(right.groupBy("r_cell", "r_part", "r_ab")).applyInArrow(score, _FOUND)
    return materialize(best_of(found, keep), "found")


def best_of(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("akey", "anchor_id", "w").orderBy(F.desc("score"), "vec_id", "rkey")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).select(
        "akey", "anchor_id", "w", "rkey", "vec_id", "score", "r")


def certified(anchors: DataFrame, rows: DataFrame, index: MultiIndex, same: bool, keep: int, first_rows: int, blocks: int) -> DataFrame:
    """Exact best ``keep`` rows of every window: a first round gives each window a floor, a second reads whatever can still reach it."""
    head = search(anchors, rows, index, same, keep, False, first_rows, blocks)
    full = head.where(F.col("r") == keep).groupBy("akey", "anchor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("w", F.col("score").cast("double")))).alias("__full"))
    floor = F.transform(F.arrays_zip("w", "low"), lambda x: F.coalesce(F.col("__full")[x["w"]], x["low"]))
    again = (anchors.join(full, (anchors["akey"] == full["akey"]) & (anchors["vec_id"] == full["anchor_id"]), "left")
             .select(anchors["akey"], "vec_id", "label", "q", "w", "low", "high", F.when(F.col("__full").isNull(), F.col("low")).otherwise(floor).alias("floor")))
    rest = search(again, rows, index, same, keep, True, first_rows, blocks)
    return best_of(head.drop("r").unionByName(rest.drop("r")), keep)


def hard_negatives(vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   cell_rows: int = 1024, part_rows: int = 4096, first_rows: int = 4096, anchor_block: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, embedding, label) that ``anchors`` holds for.

    An anchor's positives are its ``positives`` best other rows of its label, by
    the integer product of ``floor(scale * x)``; ties go to the smaller vec_id.
    For each, the best ``negatives`` rows of other labels with low * positive
    score <= 100 * score <= high * positive score.  Exact for every row: an
    anchor's reads end when no cell left can reach a window.

    Defined cases: rows with a null id, label or vector, or a null or non-finite
    component, take no part, nor does one with a component too large for scores
    below 2**56; a shorter vector counts as filled up with zeros; rows equal in
    id, label and whole numbers count once, other rows of the same id are rows of
    their own, ordered by a hash; an anchor without a positive, or a positive with
    an empty window (a negative score), gives no rows; an empty table gives none;
    other columns are not read.
    """
    rows = materialize(whole_rows(vectors, scale), "vectors")
    is_anchor = materialize(rows.where(anchors).withColumnRenamed("rkey", "akey"), "anchors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    blocks = max(1, -(-is_anchor.count() // anchor_block))
    index = fit_index(rows, max(n, 1), dims or 0, cell_rows)
    if not n:
        index.set_cells(*[np.zeros(0, np.int64)] * 3, np.zeros((0, 2)), part_rows)
        cells = rows.select("*", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("part"))
    else:
        cells = index_rows(rows, index, part_rows)
    one = [F.array(F.lit(x)).alias(k) for k, x in (("w", 0), ("low", float("-inf")), ("high", float("inf")), ("floor", float("-inf")))]
    near = materialize(certified(is_anchor.select("akey", "vec_id", "label", "q", *one), cells, index, True, positives, first_rows, blocks), "positives")
    ps = F.col("score")
    windows = (near.where(ps >= 0).groupBy("akey", "anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("r").cast("int").alias("w"), (-F.floor(-low * ps / F.lit(100).cast("decimal(3,0)"))).cast("double").alias("low"),
        F.floor(high * ps / F.lit(100).cast("decimal(3,0)")).cast("double").alias("high")))).alias("win")))
    asked = is_anchor.join(windows.withColumnRenamed("akey", "__k"), (F.col("akey") == F.col("__k")) & (F.col("vec_id") == F.col("anchor_id"))).select(
        "akey", "vec_id", "label", "q", F.col("win.w").alias("w"), F.col("win.low").alias("low"), F.col("win.high").alias("high"), F.col("win.low").alias("floor"))
    far = certified(asked, cells, index, False, negatives, first_rows, blocks)
    of = near.select("akey", "anchor_id", F.col("r").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(of, ["akey", "anchor_id", "w"]).select(
        "anchor_id", "positive_id", F.col("r").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
