"""Language identification, word first with a backoff to character n-grams.

Known words score by their log frequency in each language.  An unseen word
falls back to its character n-grams, from the longest to the shortest, and
takes the first length of which some n-gram is known.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import kept, materialize

#: A word: letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
GRACE = 20


def grams(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[i:i + n] for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language: of whole words, and of n-grams of each length up to ``max_n``."""

    langs: list[str]
    max_n: int
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    base: dict[int, np.ndarray] = field(default_factory=dict)  # by length the log frequency of what a language has not

    def score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(self.max_n, 0, -1):
            found = [v for g in grams(word, n) if (v := self.grams.get(g)) is not None]
            if found:
                return np.sum(found, axis=0) / n  # each letter is seen by n n-grams
        return np.zeros(len(self.langs), np.float32)

    def known(self, word: str) -> np.ndarray:
        """By language 1 for a word it has, else the share of the word's longest n-grams that it has."""
        v = self.words.get(word)
        has = np.zeros(len(self.langs), np.float32) if v is None else (v > self.unseen(0)).astype(np.float32)
        if has.all():
            return has
        pieces = grams(word, self.max_n)
        found = [v > self.unseen(self.max_n) for g in pieces if (v := self.grams.get(g)) is not None]
        return np.maximum(has, np.sum(found, axis=0, dtype=np.float32) / len(pieces)) if found else has

    def unseen(self, n: int) -> np.ndarray:
        return self.base.get(n, np.float32(0))


class Rows:
    """Token -> row of one matrix: a few times smaller in each worker than an array for each token.  Row -1 is of zeros."""

    def __init__(self, table: dict[str, np.ndarray], width: int):
        self.at = {t: i for i, t in enumerate(table)}
        self.rows = np.zeros((len(table) + 1, width), np.float32)
        for i, v in enumerate(table.values()):
            self.rows[i] = v

    def get(self, token: str) -> np.ndarray | None:
        i = self.at.get(token)
        return None if i is None else self.rows[i]

    def places(self, groups: list[list[str]]) -> np.ndarray:
        """The row of each token of each group, -1 for a token not there and after a group's last one."""
        sizes = np.array([len(g) for g in groups], np.int32)
        out = np.full((len(groups), sizes.max(initial=0)), -1, np.int32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = [self.at.get(t, -1) for g in groups for t in g]
        return out


def count_tables(labelled: DataFrame, max_n: int, top_words: int, top_grams: int) -> DataFrame:
    """(lang, n, token, count): the most frequent words (n = 0) and n-grams of each language."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter[str]] = {}

        def flush() -> pa.RecordBatch:
            sizes = [len(t) for t in tally.values()]
            langs = pa.array(list(tally), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()))
            out = pa.RecordBatch.from_arrays(
                [langs, pa.array([w for t in tally.values() for w in t], pa.string()),
                 pa.array([c for t in tally.values() for c in t.values()], pa.int64())], ["lang", "token", "c"])
            tally.clear()
            return out

        kept("language counts", dict)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                for lang, text in zip(s.column("lang").to_pylist(), s.column("text").to_pylist()):
                    tally.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
                    if sum(map(len, tally.values())) > 100_000:
                        yield flush()
        yield flush()

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language counts", dict)
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                s = b.slice(at, 4000)
                t: Counter[tuple[str, int, str]] = Counter()
                for lang, w, c in zip(*(s.column(k).to_pylist() for k in ("lang", "token", "c"))):
                    for n in range(1, max_n + 1):
                        for g in grams(w, n):
                            t[lang, n, g] += c
                lang, length, token = zip(*t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(length, pa.int32()), pa.array(token, pa.string()), pa.array(list(t.values()), pa.int64())],
                    ["lang", "n", "token", "c"])

    counted = (labelled.mapInArrow(count_words, "lang string, token string, c long")
               .groupBy("lang", "token").agg(F.sum("c").alias("c")))
    top = Window.partitionBy("lang").orderBy(F.desc("c"), "token")
    words = counted.withColumn("r", F.row_number().over(top)).where(F.col("r") <= top_words).drop("r")
    by_n = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "token")
    pieces = (words.mapInArrow(count_grams, "lang string, n int, token string, c long")
              .groupBy("lang", "n", "token").agg(F.sum("c").alias("c"))
              .withColumn("r", F.row_number().over(by_n)).where(F.col("r") <= top_grams).drop("r"))
    return words.select("lang", F.lit(0).alias("n"), "token", "c").unionByName(pieces)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          top_words: int = 40_000, top_grams: int = 10_000, max_n: int = 4) -> LanguageModel:
    """Fit on every row.

    ``top_words`` words and ``top_grams`` n-grams of each length bound the model
    that the driver gathers.  Rows with a null or empty text or a null language
    are not learned from.
    """
    src = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where(F.col("lang").isNotNull() & (F.length("text") > 0))
    langs = sorted(r["lang"] for r in src.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], max_n)
    rows = count_tables(src.select("lang", "text"), max_n, top_words, top_grams).toArrow().to_pylist()

    total: Counter[tuple[str, int]] = Counter()
    kinds: dict[int, dict[str, dict[str, int]]] = {}
    for r in rows:
        total[r["lang"], r["n"]] += r["c"]
        kinds.setdefault(r["n"], {}).setdefault(r["token"], {})[r["lang"]] = r["c"]
    model = LanguageModel(langs, max_n)
    for n, tokens in kinds.items():
        table = model.words if n == 0 else model.grams
        base = [math.log(0.5 / (total[g, n] + 1)) for g in langs]
        model.base[n] = np.array(base, np.float32)
        for tok, by in tokens.items():
            v = np.array([math.log((by[g] + 0.5) / (total[g, n] + 1)) if g in by else base[i] for i, g in enumerate(langs)], np.float32)
            table[tok] = v
    return model


class _Scores(dict):
    """Words beside the model's -> their places in ``rows``, filled as words appear and emptied when full.

    The first places are those of the model's own words, which stay.  ``known``
    holds :meth:`LanguageModel.known` times the letters of the word.
    """

    def __init__(self, model: LanguageModel, limit: int = 120_000, known: bool = False):
        super().__init__()
        self.model, self.limit, self.own = model, limit, len(model.words.at)
        self.rows = np.zeros((self.own + limit, len(model.langs)), np.float32)
        self.rows[:self.own] = model.words.rows[:-1]
        self.known = np.zeros_like(self.rows) if known else None
        self.to_do = np.arange(self.own + 1) < self.own * known  # own words whose ``known`` is not there yet; -1 is none

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word; no more words than ``limit`` at a time."""
        out = self.model.words.places([words])[0]
        other = np.flatnonzero(out < 0)
        unseen = [words[j] for j in other.tolist()]
        if len(self) + len(unseen) > self.limit:
            self.clear()
        self._learn([w for w in dict.fromkeys(unseen) if w not in self])
        if self.known is not None:
            own, first = np.unique(out, return_index=True)
            new = first[self.to_do[own]]
            self._fill_known([words[j] for j in new.tolist()], out[new])
            self.to_do[out[new]] = False
        out[other] = np.fromiter(map(self.__getitem__, unseen), np.int32, len(unseen))
        return out

    def __missing__(self, word: str) -> int:
        i = self.own + len(self)
        self.rows[i] = self.model.score(word)
        if self.known is not None:
            self.known[i] = self.model.known(word) * len(word)
        self[word] = i
        return i

    def _learn(self, words: list[str], at_once: int = 2000, longest: int = 60) -> None:
        """As :meth:`__missing__`, many words at a time: their n-grams are added by place, the first ones first.
        A word of more than ``longest`` letters waits until it is looked up."""
        words = [w for w in words if len(w) <= longest]
        for start in range(0, len(words), at_once):
            some = words[start:start + at_once]
            to = self.own + np.arange(len(self), len(self) + len(some))
            left = np.arange(len(some))
            for n in range(self.model.max_n, 0, -1):
                at = self.model.grams.places([grams(some[j], n) for j in left])
                total = np.zeros((len(left), self.rows.shape[1]), np.float32)
                for place in at.T:
                    total += self.model.grams.rows[place]
                self.rows[to[left]] = total / n
                if n == self.model.max_n and self.known is not None:
                    self.known[to] = self._share(some, at)
                left = left[(at < 0).all(axis=1)]
            self.update(zip(some, to.tolist()))

    def _fill_known(self, words: list[str], to: np.ndarray, at_once: int = 2000) -> None:
        """``known`` of the model's own words."""
        for start in range(0, len(words), at_once):
            some, at = words[start:start + at_once], to[start:start + at_once]
            has = (self.rows[at] > self.model.unseen(0)) * np.array([len(w) for w in some], np.float32)[:, None]
            part = np.flatnonzero((has == 0).any(axis=1))
            pieces = self.model.grams.places([grams(some[j], self.model.max_n) for j in part])
            has[part] = np.maximum(has[part], self._share([some[j] for j in part], pieces))
            self.known[at] = has

    def _share(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """By language the share of each word's longest n-grams that it has, times the letters."""
        found = np.zeros((len(words), self.rows.shape[1]), np.float32)
        for place in at.T:
            found += (self.model.grams.rows[place] > self.model.unseen(self.model.max_n)) & (place >= 0)[:, None]
        letters = np.array([len(w) for w in words], np.float32)[:, None]
        pieces = np.array([len(grams(w, self.model.max_n)) for w in words], np.float32)[:, None]
        return found / np.maximum(pieces, 1) * letters


def _words(texts: pa.Array, most: int = 50_000, together: int = 20_000) -> Iterator[list[tuple[int, list[str]]]]:
    """(text, its next words) in order, no more than ``most`` words of a text; those of short texts come together."""
    out, held = [], 0
    for i, x in enumerate(texts):  # one text as a Python string at a time, and a part of its words
        t = x.as_py()
        words = map(re.Match.group, LETTERS.finditer(t.lower() if t else ""))
        while part := list(islice(words, most)):
            out.append((i, part))
            held += len(part)
            if held >= together:
                yield out
                out, held = [], 0
    if out:
        yield out


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (columns of these names are replaced).

    ``score`` is the share of the best language among all, of the summed word
    scores (0 to 1).  A null text, or one without a letter, is ``und`` with score
    0; so is every text when the model knows no language.  Ties go to the first
    language by name.
    """
    return _predict(docs, model, text_col, False).drop("__known")


def _sent(spark: SparkSession, model: LanguageModel) -> tuple[Broadcast, str]:
    """The broadcast of a model and a name for its tables in the workers, made once: a worker holds each model it unpickles."""
    app = spark.sparkContext.applicationId
    found = model.__dict__.pop("_sent", None)  # not part of what is sent
    if found is None or found[0] != app:
        packed = replace(model, words=Rows(model.words, len(model.langs)), grams=Rows(model.grams, len(model.langs)))
        found = (app, spark.sparkContext.broadcast(packed), f"languages {uuid.uuid4().hex}")
    model.__dict__["_sent"] = found
    return found[1:]


def _predict(docs: DataFrame, model: LanguageModel, text_col: str, with_known: bool) -> DataFrame:
    """:func:`predict` plus ``__known``: the share of the letters in words or n-grams that the best language
    has (null unless asked for).  ``GRACE`` letters more count as known, so that a short text with a name in it stays."""
    sent, name = _sent(docs.sparkSession, model)
    name += " known" * with_known

    @F.arrow_udf("lang_pred string, score double, known double")
    def run(text: pa.Array) -> pa.Array:
        m = sent.value
        table = kept(name, lambda: _Scores(m, known=with_known))
        total = np.zeros((len(text), len(m.langs)), np.float64)
        known = np.zeros((len(text), len(m.langs)), np.float64)
        letters = [0] * len(text)
        for group in _words(text) if m.langs else ():
            at = table.places([w for _, part in group for w in part])
            for i, part in group:
                at_rows, at = np.split(at, [len(part)])
                total[i] += table.rows[at_rows].sum(axis=0, dtype=np.float64)
                if with_known:
                    known[i] += table.known[at_rows].sum(axis=0, dtype=np.float64)
                letters[i] += sum(map(len, part))
        names, scores, shares = [], [], []
        for by_lang, has, n in zip(total, known, letters):
            if not n:
                names.append("und")
                scores.append(0.0)
                shares.append(None)
                continue
            best = int(by_lang.argmax())
            names.append(m.langs[best])
            scores.append(float(1.0 / np.exp(np.maximum(by_lang - by_lang[best], -700)).sum()))
            shares.append(float((has[best] + GRACE) / (n + GRACE)) if with_known else None)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())],
                                          ["lang_pred", "score", "known"])

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return (docs.select(*keep, run.asNondeterministic()(F.col(text_col)).alias("__lang"))
            .select(*keep, F.col("__lang.lang_pred").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.known").alias("__known")))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame, **options) -> LanguageModel:
    """Model of the labelled rows that are not held out (rows with a null id are not used)."""
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), **options)


def known_floors(found: DataFrame, langs: list[str], least: int = 20, share: float = 0.002, slack: float = 0.7) -> dict[str, float]:
    """For each language the least share of known letters (see :func:`identify`) of its texts.

    ``found`` holds all documents with ``lang_pred`` and ``__known``.  ``slack``
    times the ``share`` quantile of all labelled rows that are held out and
    recognised, so that clean texts stay.  A language with fewer than ``least`` of
    them has no floor.
    """
    rows = (found.where(held_out() & F.col("lang").isin(langs) & (F.col("lang") == F.col("lang_pred"))).groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__known", share, 10_000).alias("q")).collect())
    return {r["lang"]: slack * r["q"] for r in rows if r["n"] >= least}


def identify(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, unchanged.

    Their language has a score of at least ``min_score`` among those learned and,
    as that says nothing of a text in none of them, at least its floor
    (:func:`known_floors`) of the text's letters is in words or n-grams it has.
    All texts are scored once, in a table that the floors and the rows come from.
    """
    src = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    found = materialize(_predict(src, model, "doc.text", True), "languages")
    floors = known_floors(found.select("doc.doc_id", "doc.lang", "lang_pred", "__known"), model.langs)
    fine = (F.col("lang_pred") != "und") & (F.col("score") >= min_score)
    if floors:
        least = F.create_map(*[F.lit(x) for g, v in floors.items() for x in (g, float(v))])
        fine &= F.col("__known") >= F.coalesce(least[F.col("lang_pred")], F.lit(0.0))
    return found.where(fine).select("doc.*")
