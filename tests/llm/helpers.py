"""Small fixtures for the corpus operators."""

from __future__ import annotations

import hashlib

#: Nulls, empty texts, repeated rows, equal ids, text of blanks, a long text.
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
LINE = "This very line stands in many documents of the corpus."
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LINE), (5, f"own\n {LINE.upper()} \nmore"), (6, f"{LINE}\n{LINE}"),
    (7, f"seven\n{LINE}\x0b"), (8, f"{LINE}\nlast of them"), (8, f"{LINE}\nlast of them"), (9, "é" * 45), (None, LINE), (None, None),
    (10, LONG), (11, LONG), (12, "Überraschung! naïve café — 123 <|im_end|> ​ \x85x y　z\x1cq"), (13, "a'b it's 12345\r\n\r\nThe  end  "),
    (14, "plain words only in this one"), (14, "another text under the same id"),
]
SCHEMA = "doc_id long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows=None, schema=SCHEMA):
    """The rows over several partitions."""
    df = spark.createDataFrame(ROWS if rows is None else rows, schema)
    return df.repartition(3) if rows is None or rows else df


def save(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
