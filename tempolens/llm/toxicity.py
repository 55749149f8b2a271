"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the words and character n-grams of a text, trained in
numpy from confirmed toxic texts and unlabelled ones.  With the share ``prior``
of toxic texts the risk is  prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior *
E_pos[l(-g)]):  the second term is the risk on clean texts, told from the
mixture, and is kept from falling below zero.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept, materialize

#: A word: letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
SPANS = (3, 4, 5)


def word_features(word: str) -> list[str]:
    """The word itself (between equals signs) and its n-grams, its ends marked by spaces."""
    w = f" {word} "
    return [f"={word}=", *{w[i:i + n] for n in SPANS for i in range(len(w) - n + 1)}]


def distinct_words(text: str) -> set[str]:
    return {m.group() for m in LETTERS.finditer(text.lower())}


@dataclass
class ToxicityModel:
    """For each classifier the weights of the features and a bias (a column each); the share of toxic texts."""

    prior: float
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def score(self, rows: np.ndarray) -> float:
        """The mean of the classifiers' probabilities for a text with these features."""
        return float((1 / (1 + np.exp(-np.clip(self.weights[rows].sum(axis=0) + self.bias, -700, 700)))).mean())


class Numbers(dict):
    """Word -> the numbers of those of its features that ``number`` has; emptied when full."""

    def __init__(self, number: dict[str, int], limit: int = 150_000):
        super().__init__()
        self.number, self.limit = number, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        number = self.number
        self[word] = got = tuple(number[f] for f in word_features(word) if f in number)
        return got

    def of(self, text: str) -> np.ndarray:
        """The feature numbers of a text, each once."""
        found: set[int] = set()
        found.update(*map(self.__getitem__, distinct_words(text)))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def notable(toxic: np.ndarray, mixed: np.ndarray, n_toxic: int, n_mixed: int, z: float = 4.0, most: int = 20_000) -> np.ndarray:
    """Features whose share of texts differs between the toxic and the unlabelled by ``z`` standard errors, the ``most`` clearest."""
    pool = (toxic + mixed) / (n_toxic + n_mixed)
    err = np.sqrt(pool * (1 - pool) * (1 / n_toxic + 1 / n_mixed))
    clear = np.abs(toxic / n_toxic - mixed / n_mixed) / np.maximum(err, 1e-12)
    best = np.argsort(-clear, kind="stable")[:most]
    return np.sort(best[clear[best] > z])


def fit_pu(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float,
           rounds: int = 300, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic classifier with the least non-negative risk (Adam, whole batches).

    ``rows`` holds the feature numbers of each text, ``positive`` marks the toxic
    ones.  Where the clean risk falls below zero, a step goes up its gradient alone.
    """
    ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share_p = positive / max(positive.sum(), 1)
    share_u = ~positive / max((~positive).sum(), 1)
    w = np.zeros(width + 1)  # the bias last
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = np.bincount(at, w[ids], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_clean = np.logaddexp(0, g)  # l(-g); its slope is p, that of l(g) is p - 1
        clean = (share_u - prior * share_p) @ loss_clean
        if clean >= 0:
            slope = prior * share_p * (p - 1) + (share_u - prior * share_p) * p
        else:
            slope = -(share_u - prior * share_p) * p
        step = np.append(np.bincount(ids, slope[at], width), slope.sum()) + decay * np.append(w[:-1], 0)
        m = 0.9 * m + 0.1 * step
        v = 0.999 * v + 0.001 * step * step
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_bag(toxic: list[str], mixed: list[str], prior: float, least: int = 4) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and bias from one bag of toxic and unlabelled texts; features in fewer than ``least`` of the toxic ones say nothing."""
    seen: Counter[str] = Counter()
    for t in toxic:
        found: set[str] = set()
        found.update(*map(word_features, distinct_words(t)))
        seen.update(found)
    names = sorted(f for f, n in seen.items() if n >= least)
    seen.clear()
    numbers = Numbers({f: i for i, f in enumerate(names)})
    rows = [numbers.of(t) for t in (*toxic, *mixed)]
    in_toxic, in_mixed = (np.bincount(np.concatenate(part), minlength=len(names)) for part in (rows[:len(toxic)], rows[len(toxic):]))
    keep = notable(in_toxic, in_mixed, len(toxic), len(mixed))
    at = np.full(len(names) + 1, -1)
    at[keep] = np.arange(len(keep))
    rows = [at[r][at[r] >= 0] for r in rows]
    weights, bias = fit_pu(rows, np.arange(len(rows)) < len(toxic), len(keep), prior)
    return [names[i] for i in keep], weights, bias


def train(toxic: DataFrame, unlabelled: DataFrame, prior: float, bags: int = 4, toxic_per_bag: int = 1000, unlabelled_per_bag: int = 1500) -> ToxicityModel:
    """Classifiers fit on the texts (id, text) of confirmed toxic rows and of unlabelled rows.

    Each of the ``bags`` classifiers is fit in a task of its own, on about
    ``toxic_per_bag`` toxic texts (all, if there are fewer) and ``unlabelled_per_bag``
    unlabelled ones that no other bag has, drawn by hashes of the rows: the only
    bounded part.  With no toxic text or a prior of 0 or 1 there is nothing to
    learn, and every score is the prior.
    """
    prior = min(max(float(prior or 0.0), 0.0), 1.0)
    n_toxic, n_mixed = toxic.count(), unlabelled.count()
    if not n_toxic or not n_mixed or not 0 < prior < 1:
        return ToxicityModel(prior, bias=np.array([np.inf if prior == 1 else -np.inf if prior == 0 else np.log(prior / (1 - prior))]))
    million = 1_000_003
    drawn = unlabelled.withColumn("h", F.xxhash64("id", "text")).where(
        F.pmod("h", F.lit(million)) < F.lit(max(1, int(million * min(1.0, bags * unlabelled_per_bag / n_mixed)))))
    drawn = drawn.dropDuplicates(["id", "text"]).select(F.pmod(F.shiftright("h", 32), F.lit(bags)).cast("int").alias("bag"), F.lit(0).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = toxic.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).where(
        F.pmod(F.xxhash64("bag", "id", "text"), F.lit(million)) < F.lit(max(1, int(million * min(1.0, toxic_per_bag / n_toxic)))))
    both = drawn.unionByName(marked.select("bag", F.lit(1).alias("role"), F.coalesce("text", F.lit("")).alias("text")))

    def fit(t: pa.Table) -> pa.Table:
        bag, role = t.column("bag")[0].as_py(), t.column("role").to_numpy()
        text = t.column("text").to_pylist()
        pos, mix = sorted(x for x, r in zip(text, role) if r), sorted(x for x, r in zip(text, role) if not r)
        del text
        names, weights, bias = fit_bag(pos, mix, prior) if pos and mix else ([], np.zeros(0), float(np.log(prior / (1 - prior))))
        return pa.table({"bag": pa.array([bag] * (len(names) + 1), pa.int32()), "feature": pa.array([*names, ""], pa.string()), "weight": np.append(weights, bias)})

    got = materialize(both.groupBy("bag").applyInArrow(fit, "bag int, feature string, weight double"), "toxicity").orderBy("bag", "feature").toArrow()
    bag, feature, weight = got.column("bag").to_numpy(), got.column("feature").to_pylist(), got.column("weight").to_numpy()
    features, numbers = np.unique(np.array(feature, object).astype(str), return_inverse=True)
    columns = np.unique(bag, return_inverse=True)[1]
    table = np.zeros((len(features), columns.max() + 1))
    table[numbers, columns] = weight
    return ToxicityModel(prior, features[1:].tolist(), table[1:], table[0])  # the bias has the empty name, which sorts first


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame, labels: DataFrame, **options: int) -> ToxicityModel:
    """Model of the rows of ``docs`` (doc_id, text) that are not held out.

    Toxic are those that ``labels`` (doc_id, toxic) marks 1 (in any of its rows);
    unlabelled are all of them, whatever their label; the prior is the share of
    toxic ids among the labelled ids not held out.  Rows with a null id or label
    teach nothing, and repeated rows of the sample teach once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("long"))).first()
    src = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    # of many toxic ids a few times those that the bags hold, so the list that goes to the texts is bounded
    share = min(1.0, 4 * options.get("bags", 4) * options.get("toxic_per_bag", 1000) / max(n_toxic or 0, 1))
    some = known.where((F.col("toxic") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(max(1, int(1_000_003 * share))))).select("doc_id")
    toxic = src.join(F.broadcast(some), "doc_id", "left_semi").where(F.length("text") > 0).select("id", "text").distinct()
    return train(materialize(toxic, "toxic"), src.select("id", "text"), (n_toxic or 0) / n if n else 0.0, **options)


def score_of(text: str | None, model: ToxicityModel) -> float:
    """The plain form of what :func:`score_texts` does for a text."""
    found = {f for w in distinct_words(text or "") for f in word_features(w)}
    return model.score(np.array([i for i, f in enumerate(model.features) if f in found], np.int32))


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, higher: toxic is likelier; a column of this name is replaced).

    Every feature counts once in a text.  A null or empty text, or one without a
    letter, has the score of the bias; repeated rows score alike; an empty table
    gives an empty result; other columns are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = f"toxicity {uuid.uuid4().hex}"

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        m = sent.value
        known = kept(name, lambda: Numbers({f: i for i, f in enumerate(m.features)}))
        out = np.full(len(text), m.score(np.zeros(0, np.int32)))
        for at in range(0, len(text), 500):  # few texts as Python strings at a time
            for i, t in enumerate(text.slice(at, 500).to_pylist(), at):
                if t and m.features:
                    out[i] = m.score(known.of(t))
        return pa.array(out)

    keep = [c for c in docs.columns if c.lower() != "score"]
    return docs.select(*keep, run(F.col(text_col)).alias("score"))
