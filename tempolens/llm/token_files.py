"""Token ids as Arrow files of fixed-size-list batches.

Every shard holds equal-length sequences (``ids``) with their ``mask`` in batches
of a fixed number of rows, so the place of sequence ``k`` follows by division and
a reader maps it without a copy.  A second file lists the shard's documents.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import text_key
from .tokens import encoder

ROWS = 64  # sequences in each batch


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    local = re.sub(r"^file:/+", "/", uri)
    return (pa.fs.LocalFileSystem(), local) if local.startswith("/") else pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one stream of ids as sequences of ``length``; the last one is padded and masked."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.dtype, self.length = dtype, length
        self.item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, packed: bytes) -> None:
        self.parts.append(packed)
        self.size += len(packed)
        full = ROWS * self.length * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.parts)
            end = len(data) - len(data) % full
            for at in range(0, end, full):
                self._batch(np.frombuffer(data, self.dtype, ROWS * self.length, at))
            self.parts, self.size = [data[end:]], len(data) - end

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        mask = np.arange(rows * self.length) < len(ids)
        ids = np.concatenate([ids, np.zeros(len(mask) - len(ids), self.dtype)])
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(np.frombuffer(b"".join(self.parts), self.dtype))
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048,
                      id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode all documents in ascending id order and write them below ``folder``; returns the shards in order.

    Each shard is a range of ids: ``ids-N.arrow`` with the sequences and
    ``docs-N.arrow`` with id, start (ids before it in the shard) and n_tokens of
    its documents.  A shard is written under a name of its own and then moved, so
    a repeated task leaves one whole file.  What the driver gets is one entry for
    each shard (shard, n_docs, n_ids), not for each document.

    Defined cases: a null or empty text is the end id alone; null ids come first;
    rows with equal ids are ordered by a hash of the text; an empty table writes
    nothing; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    ranged = src.repartitionByRange("id", "rk").sortWithinPartitions("id", "rk")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        mark = uuid.uuid4().hex
        ids_out = docs_out = writer = listing = None
        n_docs = n_ids = 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                ids_out = fs.open_output_stream(f"{root}/.ids-{shard}-{mark}")
                docs_out = fs.open_output_stream(f"{root}/.docs-{shard}-{mark}")
                writer = ShardWriter(ids_out, enc.dtype, length)
                schema = pa.schema([("id", b.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                listing = pa.ipc.new_file(docs_out, schema)
            start, size = [], []
            for packed in enc.encode(x.as_py() for x in b.column("text")):
                writer.add(packed + end)
                start.append(n_ids)
                size.append(len(packed) // enc.dtype.itemsize + 1)
                n_ids += size[-1]
            n_docs += b.num_rows
            listing.write_batch(pa.RecordBatch.from_arrays([b.column("id"), pa.array(start, pa.int64()), pa.array(size, pa.int64())], schema=schema))
        if writer is None:
            return
        writer.close()
        listing.close()
        for kind, out in (("ids", ids_out), ("docs", docs_out)):
            out.close()
            fs.move(f"{root}/.{kind}-{shard}-{mark}", f"{root}/{kind}-{shard:06d}.arrow")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_ids": [n_ids]})

    shards = ranged.mapInArrow(write, "shard long, n_docs long, n_ids long").collect()
    return sorted((r.asDict() for r in shards), key=lambda r: r["shard"])


def open_file(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file for random access; a local one is mapped, so its arrays are views of the file."""
    fs, root = file_system(folder)
    path = f"{root}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path))


def sequence(ids: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array]:
    """Sequence ``k`` of a shard and its mask, as views."""
    b = ids.get_batch(k // ROWS)
    row = b.column("ids")[k % ROWS].values
    return row.to_numpy(zero_copy_only=True), b.column("mask")[k % ROWS].values


def read_documents(spark: SparkSession, folder: str, shards: list[dict], id_type: str, id_col: str = "doc_id") -> DataFrame:
    """Every document, read back from the files: id, start (ids of all documents before it), n_tokens, ids (packed 32-bit)."""
    rows, base = [], 0
    for s in shards:
        rows.append((s["shard"], base))
        base += s["n_ids"]
    listed = spark.createDataFrame(rows, "shard long, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist()):
                yield from read_shard(folder, shard, base)

    return listed.mapInArrow(read, f"id {id_type}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def read_shard(folder: str, shard: int, base: int) -> Iterator[pa.RecordBatch]:
    ids, docs = open_file(folder, f"ids-{shard:06d}.arrow"), open_file(folder, f"docs-{shard:06d}.arrow")
    width = ids.schema.field("ids").type.list_size

    def span(a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard, from the batches that hold them; the mask must cover them."""
        out = []
        per = ROWS * width
        while a < b:
            k, at = divmod(a, per)
            batch = ids.get_batch(k)
            n = min(b - a, per - at)
            if batch.column("mask").flatten().slice(at, n).true_count != n:
                raise ValueError(f"masked ids inside a document of shard {shard}")
            out.append(batch.column("ids").flatten().slice(at, n).to_numpy(zero_copy_only=True))
            a += n
        return np.concatenate(out).astype("<u4")

    for k in range(docs.num_record_batches):
        d = docs.get_batch(k)
        for at in range(0, d.num_rows, 500):
            p = d.slice(at, 500)
            start, size = p.column("start").to_pylist(), p.column("n_tokens").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [p.column("id"), pa.array([s + base for s in start], pa.int64()), p.column("n_tokens"),
                 pa.array([span(s, s + n).tobytes() for s, n in zip(start, size)], pa.binary())], ["id", "start", "n_tokens", "ids"])
