"""Every stage of the pipeline against a plain version of it on the stage's own input."""

import pytest

import corpus_pipeline

from . import test_decontaminate as decon
from . import test_line_dedup as lines
from . import test_ngram_join as ngrams
from .helpers import LINE, ROWS, frame, save
from .test_tokens import FILES, ids_of


def plain_lines(rows):
    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(lines.WS).translate(lines.LOWER)
            if len(k) >= 40:
                docs.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        stay = []
        for line in (t or "").split("\n"):
            where = docs.get(line.strip(lines.WS).translate(lines.LOWER), ())
            if len(where) < 5 or d == max(where, key=lambda v: (v is not None, v or 0)):
                stay.append(line)
        text = "\n".join(stay) if t else t
        if text == t or text.strip(lines.WS):
            out.append((d, text))
    return out


def plain_clean(rows, items, k=10):
    """Texts without the characters from a hit word to the next one hit by the same run."""
    windows = {w for _, t in items for w in decon.windows(decon.split(t), k)}
    out = []
    for d, t in rows:
        found = [m for m in decon.WORD.finditer((t or "").translate(decon.LOWER))]
        words = [m.group() for m in found]
        hit = [False] * len(words)
        runs = [False] * len(words)  # the word goes on from the one before it
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    for j in range(i, i + n):
                        runs[j] = runs[j] or j > i
                        hit[j] = True
        if words and 2 * sum(hit) > len(words):
            continue
        # touching ranges are one range
        gone = set()
        for j in range(len(words)):
            if hit[j]:
                gone.update(range(found[j].start(), found[j].end()))
                if j and hit[j - 1]:
                    gone.update(range(found[j - 1].end(), found[j].start()))
        out.append((d, "".join(c for i, c in enumerate(t) if i not in gone) if gone else t))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("given", ["edges", "/root/testdata/sf0.01"])
def test_stages(spark, tmp_path, given):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    sf = given
    if given == "edges":
        docs = frame(spark, [*ROWS, (20, LINE + "\nthe benchmark said one two three four five six seven eight nine ten and more")]).selectExpr(
            "doc_id", "text", "if(doc_id % 2 = 0, 'xx', null) as lang", "cast(null as string) as source", "cast(length(text) as bigint) as n_chars",
            "1 as rk", "2 as id", "3 as scan", "4 as n_dropped", "'s' as score")
        sf = save(tmp_path, documents=docs, benchmark=frame(spark, [(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, before = docs.columns, rows_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        after = rows_of(docs)
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        if name == "language_id":
            left = [r for r in before if r not in after]
            assert set(after) <= set(before) and all(not any(c.isalpha() for c in t or "") for _, t in left) or given != "edges" and len(left) < 0.01 * len(before)
        elif name == "line_dedup":
            assert after == sorted(plain_lines(before), key=repr)
        elif name == "ngram_jaccard_join":
            groups = ngrams.brute(before, 5, 80)
            by_group = {}
            for (d, n, c) in groups:
                by_group.setdefault(c, set()).add(d)
            assert [d for d, _ in after] == sorted({c for _, _, c in groups}, key=repr) or given == "edges"
            assert set(after) <= set(before) and {d for d, _ in after} == {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
        else:
            assert after == sorted(plain_clean(before, items), key=repr)
        before = after
    want = sorted((repr(d), len(x)) for d, t in before for x in [ids_of(FILES[0], t, 1)])
    pieces = docs.collect()
    assert sorted({(repr(r.doc_id), r.doc_tokens) for r in pieces}) == sorted(set(want))
    assert sum(r.length for r in pieces) == sum(n for _, n in want)


def test_run_on_few_rows(spark, tmp_path):
    docs = frame(spark, ROWS).selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    sf = save(tmp_path, documents=docs, benchmark=frame(spark, [(1, "q")], "item_id long, text string"))
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"} and out.count() > 0


def test_run_on_no_rows(spark, tmp_path):
    docs = frame(spark, []).selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    sf = save(tmp_path, documents=docs, benchmark=frame(spark, [], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0
