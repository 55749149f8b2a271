"""Line deduplication over a corpus.

Normalised lines are exploded and hashed, the distinct documents of every hash
are counted, lines over the threshold are dropped everywhere but in the
document with the largest id, and the texts are put together by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_null_safe, kept, materialize, text_key, utf8

SPACE = b" \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """One row for each line that can be dropped: id, row key, position, 128-bit hash.

    The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
    with A-Z lower-cased; keys under ``min_chars`` code points give no row.
    """
    src = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lines", dict)
        for b in batches:
            row, pos, h = [], [], []
            for i, data in enumerate(utf8(b.column("text"))):
                if not data:
                    continue
                for p, line in enumerate(data.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    k = line.strip(SPACE).lower()
                    if len(k) < min_chars or not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars:
                        continue
                    row.append(i)
                    pos.append(p)
                    h.append(xxhash.xxh3_128_digest(k))
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("rk").take(take), pa.array(pos, pa.int32()), pa.array(h, pa.binary())],
                ["id", "rk", "pos", "h"])

    return src.mapInArrow(explode, f"id {id_type}, rk long, pos int, h binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """``docs`` with repeated lines removed, plus ``n_lines`` and ``n_dropped``.

    A line key found in at least ``min_docs`` distinct ids loses its lines except
    in the largest id holding it (there all stay).  The columns of ``docs`` keep
    their order; earlier columns named ``n_lines`` or ``n_dropped`` are replaced.

    Defined cases: a null or empty text is one empty line and stays as it is; a
    null id counts as one document, smaller than any other; rows that share an id
    count once, and rows equal in id and text get the same result; an empty table
    gives an empty table.
    """
    lines = materialize(line_keys(docs, id_col, text_col, min_chars), "lines")
    common = (lines.groupBy("h", "id").agg(F.lit(1).alias("one"))
              .groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
              .where(F.col("n") >= min_docs).select("h", "keep"))
    drops = (lines.join(common, "h").where(~F.col("id").eqNullSafe(F.col("keep")))
             .groupBy("id", "rk").agg(F.sort_array(F.collect_set("pos")).alias("__ld_pos"))
             .select(F.col("id").alias("__ld_id"), F.col("rk").alias("__ld_rk"), "__ld_pos"))

    @F.arrow_udf("string")
    def without(text: pa.Array, pos: pa.Array) -> pa.Array:
        kept("lines", dict)
        out = []
        for data, gone in zip(utf8(text), pos.to_pylist()):
            if data is None or gone is None:
                out.append(None)
                continue
            gone = set(gone)
            out.append(b"\n".join([x for p, x in enumerate(data.split(b"\n")) if p not in gone]))
        return pa.array(out, pa.binary()).cast(pa.string())

    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    src = docs.select(*columns, F.col(id_col).alias("__ld_id"), text_key(id_col, text_col).alias("__ld_rk"))
    text = F.col(text_col)
    joined = join_null_safe(src, drops, ["__ld_id", "__ld_rk"], "left")
    hit = F.col("__ld_pos").isNotNull()
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long") + 1
    return joined.select(
        *[F.coalesce(without(F.when(hit, text), F.col("__ld_pos")), text).alias(c) if c == text_col else F.col(c)
          for c in columns],
        n_lines.alias("n_lines"), F.when(hit, F.size("__ld_pos")).otherwise(0).cast("long").alias("n_dropped"))
