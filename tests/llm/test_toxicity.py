import zlib

import numpy as np
import pytest

from tempolens.llm import toxicity as T
from tempolens.llm.queries import op11_toxicity

from .helpers import ROWS, frame, got, save


def out(n):
    return zlib.crc32(str(n).encode()) % 3 == 1


def quality(spark, sf):
    rows = {r.doc_id: r for r in op11_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(rows) == sorted(docs) and all(r.held_out == out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    told = [(labels[i], r.predicted, r.score) for i, r in rows.items() if r.held_out and labels.get(i) is not None]
    hit = sum(y and p for y, p, _ in told)
    return hit / max(sum(p for _, p, _ in told), 1), hit / max(sum(y for y, _, _ in told), 1), told


def test_held_out_accuracy(spark):
    precision, recall, told = quality(spark, "/root/testdata/sf0.01")
    assert precision >= 0.9 and recall >= 0.6, (precision, recall)
    pos, neg = ([s for y, _, s in told if y == k] for k in (1, 0))
    assert np.mean([(p > np.array(neg)).mean() for p in pos]) > 0.8


def test_held_out_accuracy_of_more_texts(spark):
    precision, recall, _ = quality(spark, "/root/testdata/sf0.1")
    assert precision >= 0.8 and recall >= 0.8, (precision, recall)


BAD = ["you utter wobblehead", "wobbleheads all", "such a WOBBLEHEAD here", "what a wobblehead he is"]
GOOD = ["a calm day", "the sea is wide", "we read a book", "rain on the hills", "bread and salt", "an old song"]


def corpus():
    docs = [(i, f"{BAD[i // 4 % 4] if i % 4 == 0 else GOOD[i % 6]} {i % 13}") for i in range(400)]
    return docs, [(i, int(i % 4 == 0)) for i in range(400) if i % 3]


def test_learns_from_positive_and_unlabelled_only(spark):
    docs, labels = corpus()
    prior = np.mean([y for i, y in labels if not out(i)])
    only_toxic = [(i, t) for i, t in labels if t]
    toxic = frame(spark, [(str(i), t) for i, t in docs if (i, 1) in only_toxic], "id string, text string")
    model = T.train(toxic, frame(spark, [(str(i), t) for i, t in docs], "id string, text string"), prior)
    asked = [(9001, "such a wobblehead you are"), (9002, "the sea and a song"), (9003, None), (9004, ""), (9005, "12 34"), (9006, "what a wobblehead he is " * 20_000)]
    df = frame(spark, asked).selectExpr("*", "0.5 as score", "1 as feature")
    scores = {r.doc_id: r.score for r in T.score_texts(df, model).collect()}
    assert scores[9001] > 0.5 and scores[9006] > 0.5 and scores[9002] < 0.3 and scores[9003] == scores[9004] == scores[9005] < 0.7
    assert all(abs(scores[i] - T.score_of(t, model)) < 1e-9 for i, t in asked)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus()
    a = T.fit_on_documents(frame(spark, docs), frame(spark, labels, "doc_id long, toxic int"))
    turned = [(i, 1 - t if out(i) else t) for i, t in labels]
    b = T.fit_on_documents(frame(spark, docs), frame(spark, turned + [(None, 1), (7, None)], "doc_id long, toxic int"))
    assert a.features and a.features == b.features and np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(4, 1), (5, 1)], [(None, 1)], [(4, 1), (5, 0), (4, 0), (10, 1)]])
def test_odd_rows_and_labels(spark, tmp_path, labels):
    sf = save(tmp_path, documents=frame(spark), labels=frame(spark, labels, "doc_id long, toxic int").selectExpr("*", "1 as text"))
    rows = got(op11_toxicity(spark, sf), "doc_id", "held_out", "predicted")
    assert sorted(repr(r[0]) for r in rows) == sorted(repr(i) for i, _ in ROWS)
    assert all(r[1] == (r[0] is not None and out(r[0])) for r in rows)
    sf = save(tmp_path / "e", documents=frame(spark, []), labels=frame(spark, labels, "doc_id long, toxic int"))
    assert op11_toxicity(spark, sf).count() == 0


def test_risk_is_corrected_by_the_prior():
    """One telling feature: its posterior is found, though half of the unlabelled texts that have it are toxic."""
    rnd = np.random.default_rng(2)
    toxic = [np.array([0])] * 500
    mixed = [np.array([0]) if rnd.random() < 0.4 else np.zeros(0, np.int64) for _ in range(4000)]
    w, b = T.fit_pu(toxic + mixed, np.arange(4500) < 500, 1, 0.2, decay=0.0, rounds=3000)
    assert abs(1 / (1 + np.exp(-w[0] - b)) - 0.5) < 0.05 and 1 / (1 + np.exp(-b)) < 0.05
