"""The corpus pipeline: quality, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's docs. All but the last
return the columns of `documents`, whatever they are; names of their own never
clash with them.

Nulls, empty texts, ties, repeated rows and empty tables follow the operators: a
null text counts as empty, texts without words are copies of each other, one of
several equal rows stays, a null doc_id loses every tie, and no rows give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import exact_dedup, mixing, packing, quality, simhash
from framelake.llm.queries import vocabulary
from framelake.llm.shared import free_name, place, table, written
from framelake.session import ship

#: Differing bits within which the stage takes fingerprints for near copies: two more
#: than the operator's own default, as copies of which a tenth is changed differ by
#: five or more.
NEAR_RADIUS = 6

#: SQL has neither the hash of the fingerprints nor the vocabulary's merges.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the
    documents that are still there."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    scored = docs.withColumn(score, quality.score_column(docs, weights, F.col("text")))
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def _without(docs: DataFrame, settle) -> DataFrame:  # noqa: ANN001
    """docs without the rows that settle(docs, uid) lists by uid."""
    uid = free_name(docs, "uid")
    marked = docs.withColumn(uid, place(docs))
    # Written first, so that its size is known when the join is planned: a list below
    # Spark's broadcast threshold leaves the texts where they are.
    gone = written(settle(marked, uid).select(F.col("uid").alias(uid)), "gone")
    return marked.join(gone, uid, "left_anti").select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _without(docs, lambda d, uid: exact_dedup.exact_dedup(d, exact_dedup.standing(F.col("doc_id")), uid=uid).filter("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return _without(docs, lambda d, uid: simhash.near_duplicates(d, uid=uid, radius=NEAR_RADIUS).filter("keep_uid <> uid"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats as rows of their own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, *vocabulary()).withColumnRenamed("id", "doc_id")


def _shipped(stage):  # noqa: ANN001, ANN202
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _shipped(quality_filter)),
    ("exact_dedup", _shipped(exact_duplicates)),
    ("near_dedup", _shipped(near_duplicates)),
    ("source_mix", _shipped(source_mix)),
    ("packing", _shipped(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
