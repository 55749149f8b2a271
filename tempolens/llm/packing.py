"""Packing of tokenised documents into sequences of a fixed length.

Documents are dealt at random into groups; in every group the pieces are packed
first-fit decreasing, where a tournament tree over the bins' free room finds the
first bin that has enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_key
from .tokens import encoder


class TournamentTree:
    """Free room of bins in order; every inner node holds the larger of its two children."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.best = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with at least ``need`` free."""
        best, k = self.best, 1
        while k < self.size:
            k *= 2
            if best[k] < need:
                k += 1
        return k - self.size

    def take(self, b: int, used: int) -> None:
        best, k = self.best, b + self.size
        best[k] -= used
        while k > 1:
            k //= 2
            top = max(best[2 * k], best[2 * k + 1])
            if best[k] == top:
                break
            best[k] = top


def pack(lengths: list[int], room: int, min_cut: int = 64) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of 1 to ``room`` ids: (piece, first id, ids, bin, offset) rows, offsets without gaps.

    First-fit decreasing (equal lengths in the given order).  Then the bins with
    most free room give their pieces away, cut where needed, to gaps of
    ``min_cut`` or more in the others.
    """
    tree = TournamentTree(len(lengths), room)
    bins: list[list[tuple[int, int, int]]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = tree.first(lengths[i])
        tree.take(b, lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append((i, 0, lengths[i]))
    free = [room - sum(x[2] for x in b) for b in bins]
    gaps = sorted((b for b in range(len(bins)) if free[b] >= min_cut), key=lambda b: (free[b], b))
    spare = sum(free[b] for b in gaps)
    while len(gaps) > 1:
        donor = gaps.pop()  # of the most room
        spare -= free[donor]
        if spare < room - free[donor]:
            break  # its pieces don't fit into the others: they stay
        spare -= room - free[donor]
        at = 0
        while bins[donor]:
            i, start, n = bins[donor].pop()
            while n:
                b = gaps[at]
                part = min(n, free[b])
                bins[b].append((i, start, part))
                free[b] -= part
                start, n = start + part, n - part
                at += not free[b]
        del gaps[:at]
    out = []
    number = 0
    for b in bins:
        if b:
            at = 0
            for i, start, n in b:
                out.append((i, start, n, number, at))
                at += n
            number += 1
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids, cut into pieces of at most ``room``: (id, rk, start, doc_tokens, ids)."""
    src = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        step = room * enc.dtype.itemsize
        for b in batches:
            row, start, total, ids, size = [], [], [], [], 0

            def batch() -> pa.RecordBatch:
                take = pa.array(row, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("rk").take(take), pa.array(start, pa.int64()),
                     pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["id", "rk", "start", "doc_tokens", "ids"])

            for i, packed in enumerate(enc.encode(x.as_py() for x in b.column("text"))):
                packed += end
                for at in range(0, len(packed), step):
                    row.append(i)
                    start.append(at // enc.dtype.itemsize)
                    total.append(len(packed) // enc.dtype.itemsize)
                    ids.append(packed[at:at + step])
                    size += len(ids[-1])
                    if size > 8_000_000:
                        yield batch()
                        row, start, total, ids, size = [], [], [], [], 0
            yield batch()

    return src.mapInArrow(cut, f"id {kind}, rk long, start long, doc_tokens long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, room: int = 2048, docs_per_group: int = 2000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document (its ids, then ``end_id``) into sequences of at most ``room`` ids.

    One row for each piece: ``id_col``, start (the document's ids before it),
    length, doc_tokens, sequence_id, offset (in the sequence) and ids (packed
    little-endian unsigned 32-bit).  Full pieces are sequences of their own; the
    rest of each document is packed in the random group that a hash of the row
    names, so lost tasks repeat the same packing.

    Defined cases: a null or empty text is the end id alone; null and equal ids
    are documents like any other; an empty table gives no rows; other columns
    are not read.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    cut = pieces(docs, tokenizer, end_id, room, id_col, text_col)
    kind = cut.schema["id"].dataType.simpleString()
    # the pieces of a long document go to many groups
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("rk", "start"), F.lit(groups)))

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # no column but these decides the order: equal rows are alike
        table = table.sort_by([("rk", "ascending"), ("start", "ascending")]).combine_chunks()
        width = encoder(tokenizer).dtype
        data = table.column("ids").to_pylist()
        rows = pack([len(x) // width.itemsize for x in data], room)
        base = int(table.column("g")[0].as_py()) << 31
        start = table.column("start").to_pylist()
        for at in range(0, len(rows), 1000):
            part = rows[at:at + 1000]
            take = pa.array([r[0] for r in part], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [table.column("id").take(take).combine_chunks(), pa.array([start[r[0]] + r[1] for r in part], pa.int64()),
                 pa.array([r[2] for r in part], pa.int64()), table.column("doc_tokens").take(take).combine_chunks(),
                 pa.array([base + r[3] for r in part], pa.int64()), pa.array([r[4] for r in part], pa.int64()),
                 pa.array([np.frombuffer(data[r[0]], width)[r[1]:r[1] + r[2]].astype("<u4").tobytes() for r in part], pa.binary())],
                ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return dealt.groupBy("g").applyInArrow(
        lambda t: pa.Table.from_batches(list(one(t))),
        f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    ).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, room: int = 2048) -> DataFrame:
    """The sequences themselves: sequence_id, n_ids and ids (packed 32-bit), padded with zeros to ``room``
    unless the length is a power of two."""
    joined = (packed.groupBy("sequence_id")
              .agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
              .withColumn("raw", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))))
    n = F.col("n_ids").cast("int")
    even = F.bit_count(n) == 1
    return joined.select("sequence_id", "n_ids", F.when(even, F.col("raw")).otherwise(F.rpad("raw", room * 4, F.lit(b"\0"))).alias("ids"))
