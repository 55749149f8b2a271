import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempolens.llm import packing, token_files
from tempolens.llm.queries import op6_packing, op10_token_files
from tempolens.llm.tokens import Encoder

from .helpers import ROWS, frame, save

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


TOKS = {f: (plain(f), Encoder(P.path(f))) for f in FILES}


def ids_of(name, text, end):
    return [*TOKS[name][0].encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzA'st \n\t\r \x85  　\x1c​é́ßİΣ1<|endoftxt>,.-ñ漢🙂")), max_size=4))
def test_chunks_give_the_ids_of_the_text(texts):
    for t, enc in TOKS.values():
        for text, packed in zip(texts, enc.encode(texts, group_chars=7)):
            assert np.frombuffer(packed, enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzA'sStTredvlm \n\t\r \x0b1<|>,.-é×ÉßÀÿ")), max_size=4))
def test_plain_texts_give_the_ids_of_the_text(texts):
    for t, enc in TOKS.values():
        for text, packed in zip(texts, enc.encode(texts, group_chars=7)):
            assert np.frombuffer(packed, enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_every_word_goes_to_the_model_once(name):
    """Not once with each mark beside it, as chunks between white space would."""
    enc, seen = Encoder(P.path(name)), []
    tokenize = enc.words.tokenize
    enc.words.tokenize = lambda w: seen.append(w) or tokenize(w)
    text = " ".join(f"{a}word{b}" for a in "([{<" for b in ")]}>.,;!")
    assert [x.tolist() for x in (np.frombuffer(p, enc.dtype) for p in enc.encode([text, text]))] == [ids_of(name, text, 0)[:-1]] * 2
    assert len(seen) == len(set(seen)) < 20 and not enc.known


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("given", ["edges", "/root/testdata/sf0.01"])
def test_token_files(spark, tmp_path, given):
    sf = save(tmp_path, documents=frame(spark).selectExpr("*", "1 as ids", "2 as start")) if given == "edges" else given
    docs = ROWS if given == "edges" else documents(spark, sf)
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, sf).collect())
    assert [r[1] for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d))
    want = sorted((repr(d), len(x := ids_of(FILES[1], t, 2)), crc(x)) for d, t in docs)
    assert sorted((repr(d), n, c) for _, d, n, c in rows) == want
    assert [r[0] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1].tolist()]


def test_random_access_without_a_copy(spark, tmp_path):
    rows = [(i, "some words of a document " * (i % 9)) for i in range(300)]
    folder = f"file://{tmp_path}/out"
    shards = token_files.write_token_files(frame(spark, rows).repartition(3), folder, P.path(FILES[1]), 2, length=16)
    stream = [x for d, t in rows for x in ids_of(FILES[1], t, 2)]
    assert sum(s["n_ids"] for s in shards) == len(stream)
    at = 0
    for s in shards:
        f = token_files.open_file(folder, f"ids-{s['shard']:06d}.arrow")
        n = sum(f.get_batch(k).num_rows for k in range(f.num_record_batches))
        assert n == -(-s["n_ids"] // 16) and all(f.get_batch(k).num_rows == token_files.ROWS for k in range(f.num_record_batches - 1))
        for k in (0, n // 2, n - 1):
            ids, mask = token_files.sequence(f, k)
            real = min(16, s["n_ids"] - 16 * k)
            assert ids.tolist() == stream[at + 16 * k:at + 16 * k + real] + [0] * (16 - real) and not ids.flags.owndata
            assert mask.to_pylist() == [True] * real + [False] * (16 - real)
        assert f.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        at += s["n_ids"]


def test_no_documents(spark, tmp_path):
    assert token_files.write_token_files(frame(spark, []), str(tmp_path / "o"), P.path(FILES[1]), 2) == []
    assert token_files.read_documents(spark, str(tmp_path / "o"), [], "bigint").count() == 0
    assert packing.pack_documents(frame(spark, []), P.path(FILES[0]), 1).count() == 0


@pytest.mark.parametrize("given", ["edges", "/root/testdata/sf0.01"])
def test_packing(spark, tmp_path, given):
    sf = save(tmp_path, documents=frame(spark).selectExpr("*", "1 as ids", "2 as g")) if given == "edges" else given
    docs = [(d, t) for d, t in (ROWS if given == "edges" else documents(spark, sf))]
    rows = op6_packing(spark, sf).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    pieces = sorted((repr(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    by_doc = {}
    for d, t in docs:
        by_doc.setdefault(repr(d), []).append(ids_of(FILES[0], t, 1))
    for d, n, start, length, c in pieces:
        assert any(len(x) == n and crc(x[start:start + length]) == c for x in by_doc[d])
    assert sum(p[3] for p in pieces) == sum(len(x) for v in by_doc.values() for x in v)
    if given != "edges":
        spent = sum(n if n & (n - 1) == 0 else 2048 for n in (sum(x[1] for x in p) for p in seqs.values()))
        assert sum(p[3] for p in pieces) / spent > 0.99


def test_sequences_hold_the_pieces(spark):
    docs = frame(spark, [(i, "word " * (i * 7 % 50)) for i in range(60)])
    packed = packing.pack_documents(docs, P.path(FILES[0]), 1, room=64, docs_per_group=20).cache()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed, 64).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset:r.offset + r.length].tobytes() == bytes(r.ids)
    assert all(len(x) == 64 or len(x) & (len(x) - 1) == 0 for x in whole.values())


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.integers(1, 8), st.data())
def test_pack(room, min_cut, data):
    lengths = data.draw(st.lists(st.integers(1, room), max_size=60))
    rows = packing.pack(lengths, room, min_cut)
    cuts, bins = {}, {}
    for i, start, n, b, at in rows:
        cuts.setdefault(i, []).append((start, n))
        bins.setdefault(b, []).append((at, n))
    assert sorted(cuts) == list(range(len(lengths))) and sorted(bins) == list(range(len(bins)))
    for i, parts in cuts.items():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == lengths[i]
    for parts in bins.values():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= room


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=50))
def test_tree_finds_the_first_bin(lengths):
    tree, room = packing.TournamentTree(len(lengths), 20), [20] * len(lengths)
    for n in lengths:
        b = tree.first(n)
        assert b == next(i for i, r in enumerate(room) if r >= n)
        tree.take(b, n)
        room[b] -= n
