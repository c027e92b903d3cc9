"""Token counts through a digest cache.

Every text's digest, with the digest of the tokenizer's file, is looked up in a stored table of counts.
Only distinct texts that the table lacks are encoded; their counts are appended, and all documents are
joined to the table.

Digests and ids alone decide which rows are encoded: one for each digest that the table lacks.  Few such
rows are found where they are read, by a broadcast list of at most ``FEW`` of them, and only their texts
move, so none at all on a run over texts that the table knows; more of them meet the texts in a join, and
then the texts of all rows move once.  Digests that more than one row in ``HEAVY`` has get their counts by broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.llm.common import arrow_map, children, shared_dir, slices, staged, text_of

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file: another vocabulary never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


#: Rows to encode up to which they are found by a broadcast list (a digest and an id each: some MB).
FEW = 50_000
#: A digest is heavy if more than one row in so many has it; fewer digests than this can be.
HEAVY = 1000


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``; counts of new texts are appended to ``cache_path``.

    The content that is digested is the whole text with null taken as empty: any further folding could
    change a count.  Rows may repeat and ids may be null or tie: each row gets its own count.  An empty
    text has no token; a text may have any length.  Extra columns are ignored; an empty table gives no rows.
    Without ``cache_path`` a cache of this call alone is kept in the shared folder.  Each call writes a
    folder of its own below ``cache_path``, so calls may run side by side; a digest that two of them
    counted stands there twice, and reads take one.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or shared_dir(spark, "token-cache")
    body = text_of(docs, text)
    keyed = docs.select(docs[id_column].alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))

    def cached() -> DataFrame:
        runs = children(spark, cache_path)
        table = spark.read.schema(CACHE_SCHEMA).parquet(*runs) if runs else spark.createDataFrame([], CACHE_SCHEMA)
        return table.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # narrow from here on: the texts are digested, and only digests and ids go on
    held, _ = staged(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n")), "digests")
    missing, _ = staged(held.join(cached(), "digest", "left_anti").select(F.col("digest").alias("miss"), F.col("id").alias("miss_id")), "misses")
    todo = missing.count()
    if todo:
        wanted = F.broadcast(missing) if todo <= FEW else missing.hint("shuffle_hash")
        new = keyed.join(wanted, (F.col("digest") == F.col("miss")) & F.col("id").eqNullSafe(F.col("miss_id")), "left_semi").select("digest", "text")
        if todo <= FEW:  # a row that repeats is there more than once
            new = new.dropDuplicates(["digest"])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _counter(tokenizer_path)
            seen: set[bytes] = set()  # a row that repeats in this partition
            for batch in slices(batches):
                digests = batch.column("digest").to_pylist()
                new_here = [d not in seen and not seen.add(d) for d in digests]
                batch = batch.filter(pa.array(new_here, pa.bool_()))
                counts = count(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), batch.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

        arrow_map(new, encode, CACHE_SCHEMA).write.option("compression", "zstd").parquet(f"{cache_path}/run-{uuid.uuid4().hex}")
    counts, _ = staged(held.join(cached(), "digest"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter(F.col("n") * HEAVY > total).select("digest", F.col("n_tokens").alias("heavy"))
    light = counts.filter(F.col("n") * HEAVY <= total).select("digest", "n_tokens")
    rows = keyed.select("id", "digest", "n_bytes").join(F.broadcast(heavy), "digest", "left")
    known = rows.filter("heavy is not null").select("id", "n_bytes", F.col("heavy").alias("n_tokens"))
    rest = rows.filter("heavy is null").join(light, "digest").select("id", "n_bytes", "n_tokens")
    return known.unionAll(rest).withColumnRenamed("id", id_column)
