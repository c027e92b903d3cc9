"""Sources and sinks: text, JSON, audio headers, chunks and payloads.

Extraction, synthesis, recognition and page layout are done by external tools; their outputs are read
here as tables.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readalong.functions.text import metadata_path, safe_filename, strip

#: Chunk timing as it is exchanged.
CHUNK_TIMING = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])


def resolved_sources(requests: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """(request_id, status, detail, path) of requests (request_id, pdf_path, upload): 200, 400 or 404.

    Exactly one of path and upload counts as given, an empty one as none.  Relative paths resolve under
    ``root`` and must be among the paths of ``known``; an upload gets a safe name under ``root``/uploads.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    absolute = F.when(F.col("pdf_path").startswith("/"), F.col("pdf_path")).otherwise(F.concat(F.lit(f"{root}/"), "pdf_path"))
    asked = requests.withColumn("path", F.when(given("pdf_path"), absolute))
    there = known.select(F.col("path").alias("there")).distinct()
    found = asked.join(there, F.col("path") == F.col("there"), "left")
    one = given("pdf_path") != given("upload")
    missing = one & given("pdf_path") & F.col("there").isNull()
    target = F.concat(F.lit(f"{root}/uploads/"), safe_filename(F.col("upload"), F.lit("upload.pdf")))
    status = F.when(~one, 400).when(missing, 404).otherwise(200)
    detail = F.when(~one, "Provide exactly one of 'pdf_path' or 'file'.").when(missing, F.concat(F.lit("PDF not found: "), "path"))
    return found.select("request_id", status.alias("status"), detail.alias("detail"), F.when(status == 200, F.coalesce("path", target)).alias("path"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, path, text, is_blank, metadata_path) of every file below ``path``; the key is a hash of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = files.select(F.sha2("content", 256).alias("doc_key"), "path", decoded(F.col("content")).alias("text"))
    return texts.withColumn("is_blank", strip(F.col("text")) == "").withColumn("metadata_path", metadata_path(F.col("path")))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole JSON documents with a known schema; missing fields are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def source_pages(files: DataFrame) -> DataFrame:
    """One row for each page of (stem, n_pages): its index and the name of its one-page file."""
    pages = files.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_index")).filter("n_pages > 0")
    return pages.withColumn("page_name", F.format_string("%s_page_%d.pdf", "stem", F.col("page_index") + 1))


def wav_durations(files: DataFrame) -> DataFrame:
    """(path, seconds) of RIFF files (path, content); 0 where the header can't be read."""

    def seconds(content: bytes | None) -> float:
        try:
            if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
                return 0.0
            at, rate, frame = 12, 0, 0
            while at + 8 <= len(content):
                name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
                if name == b"fmt ":
                    rate, frame = struct.unpack_from("<I", content, at + 12)[0], struct.unpack_from("<H", content, at + 20)[0]
                elif name == b"data":
                    return size // frame / rate
                at += 8 + size + size % 2
        except (TypeError, struct.error, ZeroDivisionError):
            pass
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([seconds(x) for x in batch.column("content").to_pylist()], pa.float64())], ["path", "seconds"])

    return files.select("path", "content").mapInArrow(run, "path string, seconds double")


def chunk_key(stem: Column, index: Column) -> Column:
    """``<stem>_chunk_0001``; wider numbers keep all digits."""
    return F.format_string("%s_chunk_%04d", stem, index)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One row for each chunk, partitioned by a hash of the document so that folders stay few.

    What stands at ``path`` is an error; every run writes to a folder of its own.
    """
    keyed = chunks.withColumn("chunk_key", chunk_key(F.col("doc_id").cast("string"), F.col("chunk_index"))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    keyed.repartition("part").write.partitionBy("part").parquet(path)


def merge_manifest(files: DataFrame) -> DataFrame:
    """(doc_id, manifest): ``file '<path>'`` lines in chunk order, with forward slashes."""
    line = F.concat(F.lit("file '"), F.replace("path", F.lit("\\"), F.lit("/")), F.lit("'"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line"))))
    return files.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("manifest"))


def guarded_merge(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, manifest, error) of every job (doc_id): the manifest of its files, or why there is none."""
    found = jobs.join(merge_manifest(files), "doc_id", "left")
    return found.select("doc_id", "manifest", F.when(F.col("manifest").isNull(), "No audio files to merge.").alias("error"))


def alignment_payload(aligned: DataFrame) -> DataFrame:
    """(doc_id, json) of (doc_id, timing_source, spoken_word_count, pdf_word_count, words): counts, coverage in percent, and the words."""
    n = F.size("words")
    coverage = F.coalesce(F.round(F.try_divide(n * F.lit(100.0), F.col("spoken_word_count")), 2), F.lit(0.0))
    return aligned.select("doc_id", F.to_json(F.struct("timing_source", "spoken_word_count", "pdf_word_count", n.alias("aligned_word_count"), coverage.alias("coverage"), "words")).alias("json"))


def payload(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, json): counts, coverage and highlights of each document as one JSON text."""
    boxes = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "page_index", "nx0", "ny0", "nx1", "ny1", "match_score", "matched_tokens", "query_tokens"))).alias("highlights"))
    both = counts.join(boxes, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct("n_chunks", "n_mapped", "coverage", F.coalesce("highlights", F.array()).alias("highlights"))).alias("json"))
