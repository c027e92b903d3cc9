"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readalong.llm import oracles


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels whose remainder modulo 4 is not 2."""
    from readalong.llm.quality import fit, score

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_remainder(4) != 2)
    found = score(docs, fit(docs, labels.select("doc_id", F.col("quality").alias("label"))))
    return found.withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


#: Session setting that names the folder of a lasting cache of token counts.
TOKEN_CACHE = "readalong.token.cache"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by piece_bpe_32k.model.

    Counts are looked up in the cache that the session names in ``readalong.token.cache``, and new ones are
    appended to it.  Unset, each call counts all distinct texts anew, with a cache of its own.
    """
    from readalong.llm.token_counts import count_tokens

    counts = count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), spark.conf.get(TOKEN_CACHE, None))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 50 bytes that also start in an earlier document."""
    from readalong.llm.suffix_dedup import dedup

    found = dedup(_documents(spark, sf_dir), 50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: sets of 3-word shingles, similarity 0.85 or more."""
    from readalong.llm.near_dedup import classes

    return classes(_documents(spark, sf_dir), 85, 3).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of 20 words which starts earlier elsewhere."""
    from readalong.llm.substring_dedup import dedup

    found = dedup(_documents(spark, sf_dir), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and of its edited text."""
    from readalong.llm.fingerprints import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens from all documents."""
    from readalong.llm.packing import packed_documents

    return packed_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder modulo 5 is not 0."""
    from readalong.llm.language_id import fit, predict

    docs = _documents(spark, sf_dir)
    found = predict(docs, fit(docs.filter(_remainder(5) != 0)))
    return found.withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that stands, exactly or edited, in a document."""
    from readalong.llm.decontamination import matches

    return matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    from readalong.llm.license_scan import scan

    return scan(_documents(spark, sf_dir)).drop("places")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_canonical_digest": op4_canonical_digest,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_language_id": op6_language_id,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_license_scan": op8_license_scan,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
