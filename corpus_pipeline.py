"""A training corpus from ``documents``: filter, deduplicate, decontaminate, pack.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readalong.llm.common import drop_folder, staged
from readalong.llm.decontamination import clean
from readalong.llm.near_dedup import kept
from readalong.llm.packing import Limits, packed_documents
from readalong.llm.quality import accepted, fit
from readalong.llm.suffix_dedup import rewritten


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels of ``docs``, scores 0.7 or more.

    Without any label nothing is learned and every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return accepted(docs, fit(docs, labels), 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return kept(docs, 80, 5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that also start in an earlier document; those that lose all go."""
    return rewritten(docs, 50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, and their places in sequences of 1024 tokens and at most 64 documents."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), Limits(documents=64), keep_ids=True)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can express none of the learned and iterative stages as they are; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = staged(docs, f"stage-{name}")
            if before is not None:
                drop_folder(spark, before)
            before = path
    return docs
