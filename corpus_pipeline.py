"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.
``run`` writes every stage's result as a table in the shared folder and reads it
again as the next one's input.

Defined cases: a null or empty text has no language and goes in the first stage;
rows equal in id and text are treated alike; a null id is an id; an empty table
gives an empty result; other columns of ``documents`` are carried to the last
stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolens.llm import decontaminate, language, line_dedup, ngram_join, packing
from tempolens.llm._common import materialize, ship


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of the texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; others go.

    A language with fewer than 20 labelled documents held out has no limit for
    texts in none of those learned (see language.known_floors).
    """
    ship(spark)
    return language.identify(docs, language.fit_on_documents(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters found in 5 or more documents stay in the largest doc_id only; documents
    that have nothing else but white space go."""
    ship(spark)
    out = line_dedup.dedup_lines(docs.withColumn("__all", F.struct(*docs.columns)), min_chars=40, min_docs=5)
    whole = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _sized(out.where(whole).select(*[F.col("text") if c.lower() == "text" else F.col("__all")[c].alias(c) for c in docs.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more of five-word shingles."""
    ship(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark text go."""
    ship(spark)
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_coverage=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 2048 ids."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_text),
    ("packing", pack),
]

#: The language model, the shingle sets and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
