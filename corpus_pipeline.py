"""From raw documents to packed sequences in five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from rasterloom.llm.shared import Scratch, only

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this score a text has next to nothing in common with any language's profile.
LEAST_SCORE = 0.05


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects: texts without a letter, and those that are like no learned language."""
    labelled = docs.select(F.col("doc_id").alias("key"), "lang", "text")
    profiles = language_id.learn_profiles(spark, labelled.where(~language_id.held_out(F.col("key"))))
    judged = language_id.identify_languages(only(docs, *COLUMNS), profiles)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside, by the digest index."""
    return exact_dedup.keep_first(only(docs, *COLUMNS), exact_dedup.fresh_index(spark, docs=docs))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the least doc_id (a null one last); texts without a word all stay.

    Rows are told apart by doc_id and text, so a doc_id that several texts have decides for none but
    its own; rows that are alike in both stay or go together.
    """
    rows = only(docs, *COLUMNS).withColumn("row_key", F.sha2(F.to_json(F.struct("doc_id", "text")), 256))
    classes = jaccard_join.jaccard_join(spark, rows, keep=("row_key",)).where("component IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    stay = classes.groupBy("component").agg(F.min(order).alias("first"))
    gone = classes.join(stay, "component").where("row_key <> first.row_key").select("row_key").distinct()
    return rows.join(gone, "row_key", "left_anti").select(*COLUMNS)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size, by Poisson replication, in random order."""
    return mixing.mix_sources(spark, only(docs, *COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: a row for each piece, with its ids."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("jaccard_join", one_of_each_class),
    ("mixing", target_mixture),
    ("packing", packed),
]

#: SQL has neither out-of-place distances nor a byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a Parquet table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return docs
