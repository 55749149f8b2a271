"""Near-duplicate vectors by quantised tile products.

The vectors of a label are dealt into blocks; a task gets the two blocks of one
tile, quantises them to 8 bits, multiplies the integers, and adds a bound of the
quantisation error of each of the two vectors.  Only pairs that may reach the
threshold by that bound are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .components import connected_components

#: Integer products of this many 8-bit components are exact in single precision.
_EXACT = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows, their scales, the norms of the scaled rows, and the norms of what is lost."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    kept = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, slab: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (any finite, non-zero rows) with a cosine of ``threshold`` or more.

    x.y differs from the product of the scaled integers by at most
    |x'| e(y) + e(x) |y'| + e(x) e(y), with x' the scaled row and e the norm of
    the loss.
    """
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ka, ea = quantise(a / na[:, None])
    qb, sb, kb, eb = quantise(b / nb[:, None])
    fb = qb.astype(np.float32).T
    for at in range(0, len(a), slab):
        s = slice(at, at + slab)
        fa = qa[s].astype(np.float32)
        near = np.zeros((len(fa), len(b)))
        for d in range(0, a.shape[1], _EXACT):
            near += fa[:, d:d + _EXACT] @ fb[d:d + _EXACT]
        near *= sa[s, None] * sb
        near += ka[s, None] * eb + ea[s, None] * kb + ea[s, None] * eb
        i, j = np.nonzero(near >= threshold - 1e-9)
        if not len(i):
            continue
        if len(i) * 4 > near.size:  # most of the slab: one product is less work than single pairs
            cos = (a[s] @ b.T) / (na[s, None] * nb)
            i, j = np.nonzero(cos >= threshold)
            yield i + at, j
        else:
            for k in range(0, len(i), 100_000):
                x, y = i[k:k + 100_000] + at, j[k:k + 100_000]
                ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
                yield x[ok], y[ok]


def tile_links(a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of a tile (``b`` None: within ``a``), weighted by the partners' copies, and the smallest
    row of each row's component in the tile; rows of ``b`` are numbered after those of ``a``."""
    m = len(a)
    weight = na if b is None else np.concatenate([na, nb])
    links = np.zeros(len(weight), np.int64)
    root = np.arange(len(weight))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in linked_pairs(a, a if b is None else b, threshold):
        if b is None:
            own = i != j
            i, j = i[own], j[own]
            links += np.bincount(i, weight[j], len(links)).astype(np.int64)
        else:
            j = j + m
            links += np.bincount(i, weight[j], len(links)).astype(np.int64) + np.bincount(j, weight[i], len(links)).astype(np.int64)
        while len(i):  # join what is not joined yet; each pass settles one partner of every row
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j = i[apart], j[apart]
            first = np.unique(i, return_index=True)[1]
            for x, y in zip(i[first].tolist(), j[first].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            for _ in range(64):
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
    return links, root


def link_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 4096) -> DataFrame:
    """``vec_id``, n_links (other vectors of the same label with a cosine of ``threshold`` or more),
    component_id (smallest vec_id reachable by links) and kept, one row for each row of ``vectors``.

    Equal vectors of a label are one class, counted before any shuffle of single
    rows, so a group of copies costs as much as one vector.  The classes of a
    label are dealt into blocks by a hash; tile (i, j) holds two blocks.  A task
    returns link counts and a spanning forest, never pairs.

    Defined cases: a null label or vector, null, NaN or infinite components and
    zero or empty vectors link with nothing; so do vectors of different lengths;
    repeated rows are copies of each other; rows that share an id are one node of
    the graph, whose links add up; a row without an id links with nothing, its
    component is null and it is kept; an empty table gives no rows; other columns
    are not read.
    """
    src = vectors.select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = src.where(usable)
    classes = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    dims = F.size("embedding")
    sizes = classes.groupBy("label", dims.alias("dims")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (classes.withColumn("dims", dims).join(sizes, ["label", "dims"])
             .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dims", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "rep", "n", "embedding"))

    def tile(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d = t.column("dims")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
        # a power of two for each row, so squares neither overflow nor vanish
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        rep, n, side = (t.column(k).to_numpy() for k in ("rep", "n", "b"))
        order = np.lexsort((rep, side))
        rep, n, x = rep[order], n[order], x[order]
        m = len(rep) if i == j else int((side == i).sum())
        links, root = tile_links(x[:m], None if i == j else x[m:], n[:m], n[m:], threshold)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rep)
        on = links > 0
        return pa.table({"u": rep[on], "v": least[root[on]], "links": links[on]})

    found = materialize(dealt.groupBy("label", "dims", "i", "j").applyInArrow(
        tile, "u long, v long, links long"), "tiles")
    comps = connected_components(found.select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    by_class = (classes.select("label", "embedding", "rep", "n")
                .join(counts, classes["rep"] == counts["u"], "left").drop("u")
                .join(comps, F.col("rep") == F.col("node"), "left")
                .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    out = good.join(by_class, ["label", "embedding"], "left")
    rest = src.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id").unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
