"""The registered queries: each operator over its whole table with production
parameters, and the digest columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, gif, html_extract, mixing, packing, quality, secrets, simhash, token_counts
from .shared import table

VOCABULARY = "byte_bpe_50k"


def vocabulary() -> tuple[str, str]:
    """The vocabulary file for `tokenizers`, and the same one as ranks."""
    return public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), *vocabulary())
    return out.withColumnRenamed("id", "doc_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", quality.held_out("doc_id").alias("held_out"), quality.score_column(docs, weights, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup.exact_dedup(docs, exact_dedup.standing(F.col("doc_id")))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary()[0]).withColumnRenamed("id", "doc_id")


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    masked = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(masked, ","))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_spans(table(spark, sf_dir, "documents"), vocabulary()[0])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = said(F.filter("spans", lambda s: s["kind"] != "guess"))
    return out.select(F.col("id").alias("doc_id"), *map(number, secrets.KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_html_main_text, op2_best_fit_packing, op3_source_mixing, op4_simhash_components, op5_quality_scores, op6_exact_dedup, op7_gif_media, op8_token_counts, op9_chat_perspectives, op10_secret_scan)
    return {f.__name__: f for f in named}
