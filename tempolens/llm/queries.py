"""Registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat as _chat
from . import decontaminate as _decon
from . import embeddings as _embeddings
from . import extract as _extract
from . import hard_negatives as _hard
from . import language as _lang
from . import line_dedup as _lines
from . import ngram_join as _ngrams
from . import packing as _pack
from . import secrets as _secrets
from . import spelling as _spelling
from . import token_files as _files
from . import toxicity as _toxic
from ._common import new_path, ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings.link_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scan = _decon.scan_benchmark(docs, _read(spark, sf_dir, "benchmark"), window=10)
    hit = _decon.n_hit()
    return scan.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("spans.name"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("spans", lambda s: s["name"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return _extract.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return _ngrams.similar_documents(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = _pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, room=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = _lang.fit_on_documents(docs)
    return _lang.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", _lang.held_out().alias("held_out"), "lang_pred", "score")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ends = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", ends), (-1, 1, "assistant", ends)], "conv_id long, turn long, role string, text string")
    back = _chat.read_back(_chat.format_conversations(turns.unionByName(extra)))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = _lines.dedup_lines(docs, min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_path(spark, "tokens")
    shards = _files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    back = _files.read_documents(spark, folder, shards, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxic.fit_on_documents(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _toxic.score_texts(docs, model).select(
        "doc_id", _toxic.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    words = _spelling.count_words(docs, least_chars=5, least_n=3, typo_every=97)
    return _spelling.spelling_variants(words).select("word", "n", "n_near", "form", "form_n", "root")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return _hard.hard_negatives(moved, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_near_dedup, op2_benchmark_decontamination, op3_secret_scan, op4_html_extraction,
        op5_ngram_jaccard_join, op6_packing, op7_language_id, op8_chat_formatting,
        op9_line_dedup, op10_token_files, op11_toxicity, op12_spelling_variants, op13_hard_negatives,
    )}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES
    return {k: v for k, v in ORACLES.items() if k in queries()}
