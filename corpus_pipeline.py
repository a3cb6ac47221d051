"""A pipeline over the documents: language ID, near-duplicates, decontamination, packing."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vitrina.llm import decontaminate, langid, near_dedup, packing  # noqa: E402
from vitrina.session import materialize  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (not ``und``), with all columns.

    Null texts and texts without a letter go. The model learns from the stage's own input, as the query does.
    """
    held = langid.crc_remainder(F.col("doc_id"), 3) == 1
    model = langid.learn(docs.where(~held))
    # every column goes through under a name of its own, so none clashes with the operator's
    told = langid.identify(docs, model, {f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    kept = told.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id, with all columns.

    Rows with a null doc_id stay. Rows that share a doc_id stay if one of them is kept; of those with equal sets of
    shingles one stays.
    """
    found = materialize(near_dedup.near_duplicates(docs), "dedup")
    rows = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("doc_id is not null")
    dropped = materialize(rows.where("not kept").select(F.col("doc_id").alias("__id")), "dropped")
    few = dropped.count() <= near_dedup.BROADCAST_IDS
    stay = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = materialize(rows.where("kept and n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if not repeated.take(1):
        return stay
    several = stay.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi")
    once = near_dedup.with_digest(several).dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return stay.join(repeated, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with all columns."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their bins."""
    return packing.pack(docs, packing.word_count(F.col("text")), packing.exact_cluster(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: None of the stages can be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
