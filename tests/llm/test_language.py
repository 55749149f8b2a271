import random
import zlib
from dataclasses import replace

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tempolens.llm import language
from tempolens.llm.queries import op7_language_id

from .helpers import ROWS, frame, got, save


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) / len(judged) > 0.97


def test_edges(spark, tmp_path):
    docs = frame(spark).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'xx', if(doc_id = 13, null, 'yy')) as lang", "'z' as lang_pred", "1 as score")
    rows = op7_language_id(spark, save(tmp_path, documents=docs)).collect()
    assert len(rows) == len(ROWS)
    for r, (d, t) in zip(sorted(rows, key=lambda r: repr(r.doc_id)), sorted(ROWS, key=lambda x: repr(x[0]))):
        assert r.doc_id == d
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and not {4, 9, 10, 12} & und
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)


def test_no_labels_and_empty(spark):
    blank = frame(spark).selectExpr("*", "cast(null as string) as lang")
    model = language.fit_on_documents(blank)
    assert {r.lang_pred for r in language.predict(blank, model).collect()} == {"und"}
    assert language.predict(frame(spark, []), model).count() == 0


def test_backoff_takes_the_longest_known_ngrams(spark):
    rows = [(i, "alpha alpha beta", "p") for i in range(8)] + [(i, "gamma delta delta", "q") for i in range(8, 16)]
    model = language.train(frame(spark, rows, "doc_id long, text string, lang string"), max_n=3)
    assert model.langs == ["p", "q"] and model.score("alpha")[0] > model.score("alpha")[1]
    assert model.score("deltoid")[1] > model.score("deltoid")[0]  # unseen: n-grams of delta
    assert model.score("жжж").tolist() == [0, 0]


def test_many_words_score_as_each_one_does(spark, monkeypatch):
    rows = [(i, "alpha alpha beta gamma", "p") for i in range(8)] + [(i, "gamma delta delta", "q") for i in range(8, 16)]
    packed = {}
    for text in ("", "123"):  # the second model has a language and no word
        model = language.train(frame(spark, [(r[0], text or r[1], r[2]) for r in rows], "doc_id long, text string, lang string"))
        packed[text] = replace(model, words=language.Rows(model.words, 2), grams=language.Rows(model.grams, 2))
    words = ["alpha", "gamma", "deltoid", "жжж", "a", "é", "alphabeta", "gamma", "ab" * 40, "delta" * 12]
    for model in packed.values():
        single = {w: (model.score(w).tolist(), (model.known(w) * len(w)).astype(np.float32).tolist()) for w in words}
        for known in (False, True):
            table = language._Scores(model, limit=len(words), known=known)
            for some in (words, words[4:], words[::-1]):  # the table is full in between
                for w, i in zip(some, table.places(some)):
                    assert table.rows[i].tolist() == single[w][0]
                    assert not known or table.known[i].tolist() == single[w][1]
    one_by_one = []
    monkeypatch.setattr(language.LanguageModel, "score", lambda self, w: one_by_one.append(w) or np.zeros(2, np.float32))
    language._Scores(packed[""]).places(words)
    assert one_by_one == ["ab" * 40]  # only what is too long to go with others


def test_parts_of_texts(spark):
    texts = pa.array(["a b", None, "c " * 7, "", "1", "d"])
    assert [[(i, len(w)) for i, w in g] for g in language._words(texts, most=3, together=4)] == [[(0, 2), (2, 3)], [(2, 3), (2, 1)], [(5, 1)]]


def test_identify_keeps_rows_as_they_are(spark):
    rows = [(1, "alpha beta", "p", 1), (2, "123 456", "p", 2), (3, None, "q", 3), (4, "gamma delta", None, 4)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, score int")
    model = language.train(frame(spark, [(i, "alpha beta", "p") for i in range(4)] + [(i, "gamma delta", "q") for i in range(4)], "doc_id long, text string, lang string"))
    out = language.identify(docs, model)
    assert out.columns == docs.columns and got(out, *docs.columns) == [rows[0], rows[3]]


def test_texts_in_no_language_learned_go(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(7)
    other = [
        "Il governo ha annunciato ieri che la nuova legge entrerà in vigore dal prossimo anno, nonostante le proteste dei cittadini che chiedono maggiori garanzie",
        "De regering heeft gisteren aangekondigd dat de nieuwe wet volgend jaar van kracht wordt, ondanks de protesten van burgers die meer zekerheid willen",
        " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(60)),
    ]
    more = frame(spark, [(-1 - i, t, None) for i, t in enumerate(other)], "doc_id long, text string, lang string")
    left = corpus_pipeline.identify_language(spark, docs.unionByName(more), sf).select("doc_id")
    assert left.where("doc_id < 0").count() == 0
    gone = docs.join(left, "doc_id", "left_anti").collect()
    assert not [r.doc_id for r in gone if any(c.isalpha() for c in r.text or "")]


def test_all_labelled_rows_are_learned_from(spark):
    """Every document's own word is in the model, and floors are quantiles of all rows held out."""
    rows = [(i, "common " + "".join(chr(97 + int(d)) for d in str(i)), "p") for i in range(5000)]
    model = language.train(frame(spark, rows, "doc_id long, text string, lang string"))
    assert len(model.words) == 5001
    found = spark.range(12_000).selectExpr("id AS doc_id", "'p' AS lang", "'p' AS lang_pred", "id / 12000 AS __known")
    found = found.where(language.held_out())
    n, known = found.count(), sorted(r[0] for r in found.select("__known").collect())
    assert language.known_floors(found, ["p"]) == {"p": 0.7 * known[-(-n * 2 // 1000) - 1]}
