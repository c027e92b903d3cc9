"""A whole run over a corpus, as one plan: clean, chunk, time, merge, highlight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readalong.functions import text as tx
from readalong.operators import alignment, chunking, cleaning, timeline
from readalong.options import Options
from readalong.sources import io

#: What a document without speakable text ends with.
EMPTY = "Text is empty after cleaning"


def declared_durations(chunks: DataFrame) -> DataFrame:
    """Chunks with a stand-in for the length of their audio: 120 ms and 55 ms for each character."""
    return chunks.withColumn("duration_ms", F.lit(120) + F.lit(55) * F.length("text"))


def run_documents(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """One row for each document of (doc_id, text): how its run ended, and what it made.

    status (done or error), error, char_count, n_chunks, chunk_timing (index, text, start, end), total,
    manifest, final_wav, final_mp3 (null unless it is made).  A document that fails leaves the others alone.
    """
    options = (options or Options()).checked()
    stem = F.col("doc_id").cast("string")
    cleaned = cleaning.clean_documents(docs.select("doc_id", "text"), options.remove_references).select("doc_id", "clean_text", "is_empty")
    chunks = chunking.chunk_documents(cleaned, "clean_text", options.longest)
    timed = timeline.chunk_timing(declared_durations(chunks))
    entry = F.struct(F.col("chunk_index").alias("index"), "text", "start", "end", F.concat(F.lit("file 'audio/"), io.chunk_key(stem, F.col("chunk_index")), F.lit(".wav'")).alias("line"))
    made = timed.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("made"))
    done = F.col("made").isNotNull()
    # without durations a document is still there: its row says why nothing was made
    return cleaned.join(made, "doc_id", "left").select(
        "doc_id", F.when(done, "done").otherwise("error").alias("status"), F.when(~done, F.lit(EMPTY)).alias("error"), F.length("clean_text").cast("long").alias("char_count"),
        F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("n_chunks"), F.transform("made", lambda c: F.struct(c["index"].alias("index"), c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end"))).alias("chunk_timing"),
        F.coalesce(F.element_at("made", -1)["end"], F.lit(0.0)).alias("total"), F.array_join(F.transform("made", lambda c: c["line"]), "\n").alias("manifest"),
        F.when(done, F.concat(F.lit(f"{options.output_dir}/final/"), stem, F.lit(".wav"))).alias("final_wav"),
        F.when(done & F.lit(options.generate_mp3), F.concat(F.lit(f"{options.output_dir}/final/"), stem, F.lit(".mp3"))).alias("final_mp3"),
    )


def highlighted(runs: DataFrame, printed: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_mapped, coverage) of finished runs against their pages' words (doc_id, word_idx, norm, page_index, box)."""
    chunks = runs.filter("status = 'done'").select("doc_id", F.explode("chunk_timing").alias("c")).select("doc_id", F.col("c.index").alias("chunk_index"), tx.tokens(F.col("c.text")).alias("chunk"))
    found = alignment.highlights(alignment.match_chunks(chunks, alignment.word_arrays(printed)), printed)
    return alignment.coverage(chunks, found)
