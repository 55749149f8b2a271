"""Jaccard self-join on word n-grams with vertical partitioning.

All n-grams have one global order: by 64-bit hash, the very frequent ones last.
The order is cut into fragments.  The first part of each set in that order finds
the candidate pairs; the parities of the sets' segment sizes in many thin fragments
bound each pair's overlap and drop most of them; for the others every fragment
counts its partial overlaps on its own, and the sum per pair decides.

Only connected groups are wanted, so no step forms all pairs of a list of sets
that share an n-gram.  Each list is compared with one member; then, where it is
not connected, with its best connected member, the centre.  A set that links to a
centre has its other partners at twice the allowed distance from the centre at
most (the Jaccard distance is a metric), so these few are compared with each other
in tiles, by partial overlaps per fragment, and only links leave the task.  Sets of
a list that link to no centre are left; their pairs are bounded by parities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_null_safe, kept, materialize, text_key, utf8
from .components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fragments of the order for counting overlaps.
FRAGMENTS = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Jaccard:
    """Word n-grams of ``n``, similar from ``percent`` per cent."""

    n: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if not 50 < self.percent <= 100:
            raise ValueError("the similarity must be over 50 and at most 100 per cent")

    def of_neighbours(self) -> Jaccard:
        """What two sets have in common at least that are both similar to a third."""
        if self.percent <= 75:
            raise ValueError("the similarity must be over 75 per cent")
        return Jaccard(self.n, 2 * self.percent - 100)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """So many n-grams, first in the order, share one with every similar set."""
        return size - (size * self.percent + 99) // 100 + 1

    def enough(self, overlap, size_a, size_b):
        """|A and B| / |A or B| >= percent / 100, in integers (Columns or arrays)."""
        return overlap * (100 + self.percent) >= self.percent * (size_a + size_b)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def gram_set(data: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; the whole sequence is one when it has fewer words."""
    words = data.translate(_LOWER).split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("words", _WordHashes).__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    g = h[:len(h) - k + 1] + np.uint64(k)
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(29))) * _A + h[i:len(h) - k + 1 + i]
    g = (g ^ (g >> np.uint64(32))) * _B
    return np.unique(g ^ (g >> np.uint64(32)))


def set_key(grams: np.ndarray) -> int:
    """Names a set: equal sets have equal keys (signed 64 bits)."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams)) - (1 << 63)


def parities(grams: np.ndarray) -> np.ndarray:
    """One bit for each of 64, 128, ... fragments (at least twice as many as n-grams): its segment's size is odd.

    Fragments are named by the low bits of the hashes, so the first half of the
    bits XOR the second is what half as many fragments give.
    """
    n = max(64, 1 << (len(grams) - 1).bit_length() + 1)
    odd = np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _long(grams: np.ndarray) -> pa.Array:
    return pa.array(grams.view(np.int64))


#: N-grams of a stretch of documents and rows taken at a time: they bound what a worker of :func:`describe` holds.
STRETCH, ROWS = 500_000, 500


def described_rows(batches: Iterator[pa.RecordBatch], how: Jaccard, hot_share: float) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`describe` for a stream of (id, rk, text); n-grams are counted a stretch at a time."""
    names = ["id", "rk", "size", "key", "bits", "gram"]
    seen: dict[int, np.ndarray] = {}
    held = 0

    def hot(id_type: pa.DataType) -> pa.RecordBatch:
        got, n = np.unique(np.concatenate([*seen.values(), np.empty(0, np.uint64)]), return_counts=True)
        often = n >= max(5, hot_share * len(seen))
        k = int(often.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.array(n[often], pa.int64()), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.list_(pa.int64())), _long(got[often])], names)

    id_type = None
    for whole in batches:
        id_type = whole.column("id").type
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            sets = [gram_set(x, how.n) for x in utf8(b.column("text"))]
            keys = [set_key(g) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rk"), pa.array([len(g) for g in sets], pa.int64()), pa.array(keys, pa.int64()),
                 pa.array([parities(g) for g in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int64())], names)
            for key, g in zip(keys, sets):
                if key not in seen:
                    seen[key] = g
                    held += len(g)
                    if held > STRETCH:
                        yield hot(id_type)
                        seen.clear()
                        held = 0
    if seen:
        yield hot(id_type)


def describe(docs: DataFrame, how: Jaccard, hot_share: float) -> DataFrame:
    """One row per document (id, rk, size, key, bits), and rows (gram, n) of n-grams frequent in a stretch of documents.

    An n-gram found in more than ``hot_share`` of all documents is that frequent
    in one stretch at least, so none is missed.  Equal sets count once in a stretch.
    """
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: described_rows(batches, how, hot_share),
                           f"id {kind}, rk long, size long, key long, bits array<long>, gram long")


def shared_prefixes(docs: DataFrame, how: Jaccard, hot: Broadcast[np.ndarray], buckets: int) -> DataFrame:
    """Rows (gram, key, pivot): the sets whose prefix has an n-gram that other prefixes have.

    ``pivot`` is the set that the others of its list are compared with first.
    The lists of frequent n-grams are split by a hash of the set, with a pivot
    for each part.
    """
    parts = 64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = hot.value
        for b in batches:
            grams, keys, done = [], [], set()
            for data in utf8(b.column("text")):
                g = gram_set(data, how.n)
                if not len(g) or (key := set_key(g)) in done:
                    continue
                done.add(key)
                late = order[np.searchsorted(order, g).clip(max=len(order) - 1)] == g if len(order) else np.zeros(len(g), bool)
                p = np.concatenate([g[~late], g[late]])[:how.prefix(np.int64(len(g)))]
                grams.append(p)
                keys.append(np.full(len(p), key, np.int64))
            if not grams:
                continue
            g, k = np.concatenate(grams), np.concatenate(keys)
            part = np.where(np.isin(g, order), k % parts, 0)
            at = ((g ^ (part.astype(np.uint64) * _A)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(at, kind="stable")
            g, k, at = g[by], k[by], at[by]
            ends = np.flatnonzero(np.diff(at, append=-1)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[starts]), pa.array([g[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary()),
                 pa.array([k[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary())], ["bucket", "grams", "keys"])

    def lists(t: pa.Table) -> pa.Table:
        order = hot.value
        g = np.frombuffer(b"".join(t.column("grams").to_pylist()), np.uint64)
        k = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
        frequent = np.isin(g, order)
        part = np.where(frequent, k % parts, 0)
        # two orders, chosen by the n-gram: a poor pivot of one list is none in others
        mixed = (k.view(np.uint64) ^ (g % np.uint64(2) * _B)) * _A
        by = np.lexsort((k, mixed, part, g))
        g, k, part, frequent = g[by], k[by], part[by], frequent[by]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])  # equal sets of several batches
        g, k, part, frequent = g[fresh], k[fresh], part[fresh], frequent[fresh]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (part[1:] != part[:-1])
        run = np.cumsum(first) - 1
        more = (np.bincount(run)[run] > 1) | frequent
        pivot = k[np.flatnonzero(first)[run]] if len(g) else k
        return pa.table({"gram": _long(g[more]), "key": pa.array(k[more]), "pivot": pa.array(pivot[more])})

    return (docs.select("text").mapInArrow(cut, "bucket long, grams binary, keys binary")
            .groupBy("bucket").applyInArrow(lists, "gram long, key long, pivot long"))


def xor(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))


def halved(x: Column) -> Column:
    """The parities of half as many fragments, one word at least."""
    h = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > 1, xor(F.slice(x, 1, h), F.slice(x, h + 1, h))).otherwise(x)


def differing(a: Column, b: Column) -> Column:
    """Number of fragments whose segment sizes differ in parity: so many n-grams at least are in one set only.

    Sets of similar sizes have equally many fragments, or one has twice as many.
    """
    fewer = F.least(F.size(a), F.size(b))
    fit = lambda x: F.when(F.size(x) > fewer, halved(x)).otherwise(x)
    return F.aggregate(xor(fit(a), fit(b)), F.lit(0), lambda s, x: s + F.bit_count(x))


def may_link(pairs: DataFrame, sets: DataFrame, how: Jaccard) -> DataFrame:
    """The distinct pairs (x, y) that sizes and then parities don't rule out, with their set sizes."""
    def side(k: str, *cols: str) -> DataFrame:
        return sets.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in cols])

    sizes = F.col("size_x"), F.col("size_y")
    near = (pairs.distinct().join(side("x", "size"), "x").join(side("y", "size"), "y")
            .where(how.enough(F.least(*sizes), *sizes)))
    most = (sizes[0] + sizes[1] - differing(F.col("bits_x"), F.col("bits_y"))) / 2
    return (near.join(side("x", "bits"), "x").join(side("y", "bits"), "y").where(how.enough(most, *sizes))
            .select("x", "y", "size_x", "size_y"))


#: Rows of (key, id, rk) that a join may broadcast, about 20 MB; more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000


def segments(keys: DataFrame, docs: DataFrame, sets: DataFrame, how: Jaccard) -> DataFrame:
    """The segments of the sets named by the column ``key``, from their texts: (key, f, seg), written."""
    rows = materialize(keys.distinct().join(sets, "key").select("key", F.col("id").alias("w_id"), F.col("rk").alias("w_rk")), "wanted")
    if rows.count() <= BROADCAST_KEYS:
        rows = F.broadcast(rows)
    texts = docs.join(rows, docs["id"].eqNullSafe(F.col("w_id")) & (docs["rk"] == F.col("w_rk"))).select("key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                key, frag, seg = [], [], []
                for k, data in zip(s.column("key").to_pylist(), utf8(s.column("text"))):
                    g = gram_set(data, how.n)
                    ends = np.searchsorted(g >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                    for f in range(FRAGMENTS):
                        if ends[f] < ends[f + 1]:
                            key.append(k)
                            frag.append(f)
                            seg.append(g[ends[f]:ends[f + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(frag, pa.int32()), pa.array(seg, pa.list_(pa.int64()))], ["key", "f", "seg"])

    # rows equal in id and text give equal segments
    return materialize(texts.mapInArrow(cut, "key long, f int, seg array<long>").dropDuplicates(["key", "f"]), "segments")


def overlaps(pairs: DataFrame, docs: DataFrame, sets: DataFrame, how: Jaccard) -> DataFrame:
    """The similar ones of the pairs, with their overlap ``o``: each fragment counts partial overlaps, and
    their sum per pair is the overlap."""
    keys = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key")))
    segs = segments(keys, docs, sets, how)
    x = segs.select(F.col("key").alias("x"), "f", F.col("seg").alias("seg_x"))
    y = segs.select(F.col("key").alias("y"), "f", F.col("seg").alias("seg_y"))
    partial = (pairs.join(x, "x").join(y, ["y", "f"])
               .select("x", "y", "size_x", "size_y", F.size(F.array_intersect("seg_x", "seg_y")).alias("o")))
    return (partial.groupBy("x", "y", "size_x", "size_y").agg(F.sum("o").alias("o"))
            .where(how.enough(F.col("o"), F.col("size_x"), F.col("size_y"))))


def blocks_of(rows: DataFrame, group: str, block: int) -> DataFrame:
    """``rows`` (group, key, comp) of the groups with several components, dealt into tiles (i, j) of two blocks; b is a row's own."""
    several = (rows.groupBy(group).agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .where("lo <> hi").select(F.col(group).alias("g"), F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    n = F.col("blocks")
    return (rows.join(several, F.col(group) == F.col("g"))
            .withColumn("b", F.pmod(F.xxhash64("key"), n).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .select(group, "key", "comp", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j")))


def link_groups(rows: DataFrame, docs: DataFrame, sets: DataFrame, how: Jaccard, block: int = 512) -> DataFrame:
    """Links (u, v) between sets of one group (centre, key, comp) that are in different components.

    A task has the sets of one tile, adds up the partial overlaps of all its pairs
    fragment by fragment, and returns links that join components, not pairs.
    """
    tiles = materialize(blocks_of(rows, "centre", block), "tiles")
    segs = segments(tiles.select("key"), docs, sets, how).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("f", "seg"))).alias("s"))
    whole = segs.select("key", F.flatten("s.seg").alias("grams"))  # the order of hashes as unsigned numbers

    def tile(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, comp, side = (t.column(c).to_numpy() for c in ("key", "comp", "b"))
        lists = t.column("grams").combine_chunks()
        flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        at = at - at[0]
        size = np.diff(at)
        row = np.repeat(np.arange(len(key)), size)
        order = np.argsort(flat, kind="stable")
        g, r = flat[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1
        col, r = np.unique(col[shared], return_inverse=True)[1], r[shared]
        total = np.zeros((len(key), len(key)), np.float32)
        width = 2048  # columns of a fragment
        for c in range(0, int(col.max(initial=-1)) + 1, width):
            a, e = np.searchsorted(col, [c, c + width])
            x = np.zeros((len(key), width), np.float32)
            x[r[a:e], col[a:e] - c] = 1
            total += x @ x.T
        ok = how.enough(total.astype(np.int64), size[:, None], size[None, :]) & (comp[:, None] != comp[None, :])
        if (side != side[0]).any():
            ok &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(ok, 1))
        # one link for each two components is enough
        pair = np.unique(np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])]), axis=1, return_index=True)[1]
        return pa.table({"u": key[i[pair]], "v": key[j[pair]]})

    return (tiles.join(whole, "key").groupBy("centre", "i", "j").applyInArrow(tile, "u long, v long"))


def unconnected(rows: DataFrame, sets: DataFrame, how: Jaccard, block: int = 2048) -> DataFrame:
    """Pairs (x, y) of sets of one list (gram, key, comp) and of different components that sizes and parities don't rule out.

    A list of more than ``block`` sets is dealt into tiles of two blocks.
    """
    thin = halved(halved(F.col("bits")))  # they travel with each row, so fewer do
    tiled = (blocks_of(rows, "gram", block)
             .withColumn("tile", F.xxhash64("gram", "i", "j"))
             .join(sets.select("key", "size", thin.alias("bits")), "key")
             .withColumn("task", F.pmod("tile", F.lit(4096))))

    def pairs(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tile, key, comp, size, side = (t.column(c).to_numpy() for c in ("tile", "key", "comp", "size", "b"))
        packed = t.column("bits").combine_chunks()
        flat, at = packed.flatten().to_numpy().view(np.uint64), packed.offsets.to_numpy()
        at = at - at[0]
        by = np.lexsort((size, tile))
        tile, key, comp, size, side = tile[by], key[by], comp[by], size[by], side[by]
        width, at = np.diff(at)[by], at[by]
        ends = np.flatnonzero(np.diff(tile, append=tile[-1] ^ 1)) + 1
        out_x, out_y = [], []
        for a, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            top = np.searchsorted(size[a:e], size[a:e] * 100 // how.percent, side="right") + a  # sizes that can be similar
            alike = (side[a:e] == side[a]).all()  # one block with itself
            # rows of equal width are neighbours; `half` is the next width's rows with half the fragments
            whole, half, starts = {}, {}, {}
            for w in np.unique(width[a:e]).tolist():
                rows = np.flatnonzero(width[a:e] == w) + a
                whole[w], starts[w] = np.stack([flat[at[k]:at[k] + w] for k in rows.tolist()]), rows[0]
                half[w] = whole[w][:, :w // 2] ^ whole[w][:, w // 2:] if w > 1 else None
            for i in range(a, e - 1):
                j = np.arange(i + 1, top[i - a])
                j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | alike)]
                if len(j):
                    w = int(width[i])
                    same = j[width[j] == w]
                    wide = j[width[j] == 2 * w]
                    own = whole[w][i - starts[w]]
                    odd = [np.bitwise_count(m ^ own).sum(axis=1, dtype=np.int64) for m in (
                        whole[w][same - starts[w]], *([half[2 * w][wide - starts[2 * w]]] if len(wide) else []))]
                    j = np.concatenate([same, wide])
                    j = j[how.enough((size[j] + size[i] - np.concatenate(odd)) / 2, size[j], size[i])]
                    out_x.append(np.minimum(key[j], key[i]))
                    out_y.append(np.maximum(key[j], key[i]))
        x, y = (np.concatenate([*o, np.empty(0, np.int64)]) for o in (out_x, out_y))
        both = np.unique(np.stack([x, y]), axis=1)
        return pa.table({"x": both[0], "y": both[1]})

    return tiled.select("task", "tile", "key", "comp", "size", "b", "bits").groupBy("task").applyInArrow(pairs, "x long, y long")


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                      hot_share: float = 0.002, max_hot: int = 200_000, bucket_grams: int = 200_000) -> DataFrame:
    """One row for each row of ``docs``: id, rk (row key), n_shingles and component_id.

    A document's set is its distinct word n-grams (words ``[^\\x20\\x09-\\x0D]+``, A-Z
    lower-cased); with fewer words the whole sequence is the one element.  Two
    documents link when their sets' Jaccard similarity is ``percent`` per cent or
    more; ``component_id`` is the smallest id reachable by links.

    ``percent`` is over 75.  Equal sets are one node, named by a 64-bit key.  ``max_hot`` bounds the
    frequent n-grams sent to the tasks (the most frequent ones); they only order
    the n-grams, so which ones they are changes no result.

    Defined cases: a null text, or one without words, has an empty set and links
    with nothing (its component is its own id); documents that share an id are
    one node of the graph; a null id is never the smallest of a component unless
    all its ids are null; an empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    how = Jaccard(n, percent)
    src = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    described = materialize(describe(src, how, hot_share), "sets")
    rows = described.where("key is not null").drop("gram")
    often = (described.where("gram is not null").groupBy("gram").agg(F.sum("size").alias("n"))
             .orderBy(F.desc("n"), "gram").limit(max_hot).select("gram").toArrow())
    hot = spark.sparkContext.broadcast(np.sort(often.column(0).to_numpy().astype(np.int64).view(np.uint64)))

    # equal sets: one node, and any of its rows for the text
    sets = materialize(rows.where("size > 0").groupBy("key").agg(
        F.min("id").alias("least"), F.min(F.struct("rk", "id")).alias("one"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits"))
        .select("key", "least", "one.id", "one.rk", "size", "bits"), "classes")
    total = sets.agg(F.sum("size")).first()[0] or 0
    buckets = int(total * (100 - percent) // 100 // bucket_grams) + 8
    lists = materialize(shared_prefixes(src.select("text"), how, hot, buckets), "lists")

    def pairs(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]

    def ends(links: DataFrame) -> DataFrame:
        return links.select(F.col("x").alias("u"), F.col("y").alias("v"))

    def with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
        return rows.join(comps, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "key")).drop("node", "component")

    close = how.of_neighbours()
    linked = how.enough(F.col("o"), F.col("size_x"), F.col("size_y"))
    # each list with one of its sets
    first = materialize(may_link(lists.where("key <> pivot").select(*pairs("key", "pivot")), sets, close), "pairs")
    near = materialize(overlaps(first, src, sets, close), "near")
    links = ends(near.where(linked))
    comps = connected_components(links)
    # the lists that are not connected, with their centre
    degree = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("d_key")).agg(F.count(F.lit(1)).alias("d"))
    open_lists = (with_comp(lists, comps).groupBy("gram").agg(
        F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("pivot").alias("p"), F.max("pivot").alias("q"))
        .where("lo <> hi and (m > 2 or p <> q)").select("gram"))
    left = lists.select("gram", "key").join(open_lists, "gram", "left_semi").join(degree, F.col("key") == F.col("d_key"), "left")
    centres = left.groupBy(F.col("gram").alias("c_gram")).agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "key"))["key"].alias("centre"))
    left = materialize(left.join(centres, F.col("gram") == F.col("c_gram")).select("gram", "key", "centre"), "open")
    second = materialize(may_link(left.where("key <> centre").select(*pairs("key", "centre")), sets, close)
                         .join(first.select("x", "y"), ["x", "y"], "left_anti"), "pairs")
    near = materialize(near.unionByName(overlaps(second, src, sets, close)), "near")
    links = ends(near.where(linked))
    comps = connected_components(links)
    # around each centre, the sets that may link to a set that links to the centre
    named = left.select("centre").distinct()
    around = (near.select(F.col("x").alias("centre"), F.col("y").alias("key"), linked.alias("linked"))
              .unionByName(near.select(F.col("y").alias("centre"), F.col("x").alias("key"), linked.alias("linked")))
              .join(named, "centre", "left_semi"))
    groups = around.select("centre", "key").unionByName(named.select("centre", F.col("centre").alias("key")))
    more = materialize(link_groups(with_comp(groups, comps), src, sets, how), "links")
    # the sets of a list that link to no centre
    alone = left.where("key <> centre").join(around.where("linked").select("centre", "key"), ["centre", "key"], "left_anti").select("gram", "key")
    third = materialize(may_link(unconnected(with_comp(alone, comps), sets, how), sets, how), "pairs")
    edges = links.unionByName(more).unionByName(ends(overlaps(third, src, sets, how)))

    # nodes of one id are one node; components are named by the smallest id
    same = (rows.where("size > 0 and id is not null").groupBy("id").agg(F.min("key").alias("u"), F.max("key").alias("v"))
            .where("u <> v"))
    if same.limit(1).count():
        shared = rows.where("size > 0").join(same.select("id", "u"), "id").select("u", F.col("key").alias("v")).where("u <> v")
        edges = edges.unionByName(shared)
    final = connected_components(edges)
    named = (final.join(sets.select("key", "least"), F.col("node") == F.col("key"))
             .groupBy("component").agg(F.min("least").alias("name")))
    names = final.join(named, "component").select(F.col("node").alias("n_key"), "name")
    by_key = (sets.join(names, F.col("key") == F.col("n_key"), "left")
              .select(F.col("key").alias("k"), F.coalesce("name", "least").alias("component")))
    full = rows.where("size > 0").join(by_key, F.col("key") == F.col("k"), "left").select(
        "id", "rk", "size", F.coalesce("component", "id").alias("component"))
    empty = rows.where("size = 0").select("id", "rk", "size", F.col("id").alias("component"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), "rk", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates: of each component the row of the smallest doc_id stays.

    Rows whose set is empty stay.  Of rows that share that id, the one with the
    smallest row key stays; rows without an id stay unless they link to one that has.
    """
    found = similar_documents(docs, n, percent)
    stays = (found.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("rk").alias("rk")))
    lone = found.where((F.col("n_shingles") == 0) | F.col("component_id").isNull()).select("doc_id", "rk").distinct()
    keep = stays.select("doc_id", "rk").unionByName(lone).select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"))
    src = docs.withColumns({"__id": F.col("doc_id"), "__rk": text_key("doc_id", "text")})
    return join_null_safe(src, keep, ["__id", "__rk"], "left_semi").select(*docs.columns)
