import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tempolens.llm import decontaminate as D
from tempolens.llm.queries import op2_benchmark_decontamination

from .helpers import ROWS, frame, got, save, sha

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def windows(words, k=10):
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    where = {}
    for name, t in items:
        for w in windows(split(t), k):
            where.setdefault(w, set()).add(str(name))
    sizes = {len(w) for w in where}
    out = []
    for d, t in docs:
        words, hit, names = split(t), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = where.get(tuple(words[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((d, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return sorted(out, key=repr)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(r[-1] for r in want)
    assert got(op2_benchmark_decontamination(spark, sf), *COLS) == want


ITEMS = [(1, None), (2, ""), (3, "?!"), (4, "plain words only"), (5, "PLAIN words only in this one"), (5, "w5x"),
         (6, " ".join(f"w{i}x" for i in range(40, 60))), (7, "This very line stands in many documents of the corpus."), (8, "words only")]


def test_edges(spark, tmp_path):
    sf = save(tmp_path, documents=frame(spark).selectExpr("*", "'s' as scan", "1 as n_words"), benchmark=frame(spark, ITEMS, "item_id long, text string"))
    assert got(op2_benchmark_decontamination(spark, sf), *COLS) == brute(ROWS, ITEMS)


def test_shards_and_empty_tables(spark):
    docs, items = frame(spark), frame(spark, ITEMS, "item_id long, text string")
    one = D.scan_benchmark(docs, items).select("doc_id", "text", "scan").collect()
    many = D.scan_benchmark(docs, items, shard_chars=60).select("doc_id", "text", "scan").collect()
    assert sorted(one, key=repr) == sorted(many, key=repr)
    none = frame(spark, [], "item_id long, text string")
    assert all(not r.scan.hits for r in D.scan_benchmark(docs, none).collect())
    assert D.scan_benchmark(frame(spark, []), items).count() == 0


def test_spans_go_and_clean_rows_stay(spark):
    clean, item = "nothing of that kind here", " ".join(f"q{i}" for i in range(12))
    rows = [(1, clean), (2, f"{'before ' * 20}{item.upper()}! after"), (3, item), (4, None)]
    out = D.decontaminate(frame(spark, rows).selectExpr("*", "1 as hits"), frame(spark, [(1, item)], "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "hits"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, clean), (2, f"{'before ' * 20}! after"), (4, None)]


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 4), st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton(k, items, doc):
    named = [(str(i), [w.encode() for w in seq]) for i, seq in enumerate(items)]
    sam = D.SuffixAutomaton(k)
    for _, seq in named:
        sam.add(seq)
    sam.seal(named)
    hits, names = sam.scan([w.encode() for w in doc])
    want = brute([(0, " ".join(doc))], [(i, " ".join(s)) for i, s in enumerate(items)], k)[0]
    assert (sum(b - a for a, b in hits), sha(",".join(sorted(names)))) == (want[2], want[4])


def test_order_of_items_does_not_matter():
    items = [(str(i), [random.Random(i).choice([b"x", b"y"]) for _ in range(12)]) for i in range(6)]
    doc = [random.Random(99).choice([b"x", b"y"]) for _ in range(200)]
    seen = set()
    for order in (items, items[::-1]):
        sam = D.SuffixAutomaton(5)
        for _, s in order:
            sam.add(s)
        sam.seal(order)
        hits, names = sam.scan(doc)
        seen.add((tuple(hits), tuple(sorted(names))))
    assert len(seen) == 1
