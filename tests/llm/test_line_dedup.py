from collections import defaultdict

import pytest

from tempolens.llm import line_dedup
from tempolens.llm.queries import op9_line_dedup

from .helpers import ROWS, frame, got, save, sha

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(WS).translate(LOWER)
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(docs[key(x)]) >= min_docs and d != max(docs[key(x)], key=lambda v: (v is not None, v or 0)))]
        out.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_query_equals_brute_force(spark, tmp_path):
    sf = save(tmp_path, documents=frame(spark))
    assert got(op9_line_dedup(spark, sf), *COLS) == brute(ROWS)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op9_line_dedup(spark, sf), *COLS) == brute(rows)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_small_thresholds(spark, min_docs):
    rows = [(1, "aa\nbb\naa"), (2, "bb\n cc"), (3, "cc\nAA\ndd"), (4, "x\n\naa"), (4, "bb")]
    out = line_dedup.dedup_lines(frame(spark, rows), min_chars=2, min_docs=min_docs)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in out.collect()) == brute(rows, 2, min_docs)


def test_empty_and_other_columns(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    df = frame(spark).selectExpr("doc_id", "text", "'k' as h", "7 as id", "'r' as rk", "3 as N_LINES", "1 as pos", "2 as keep", "array(1) as n")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "h", "id", "rk", "pos", "keep", "n", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, sha(r.text or "")) for r in out.collect()), key=repr) == brute(ROWS)
    assert {(r.h, r.id, r.rk, r.keep) for r in out.collect()} == {("k", 7, "r", 2)}
