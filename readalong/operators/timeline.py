"""Timelines of chunks and words: running sums over each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readalong.functions.text import rounded, tokens


def chunk_timing(chunks: DataFrame) -> DataFrame:
    """``start`` and ``end`` in seconds from ``duration_ms``; sums are whole milliseconds, rounded once."""
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    elapsed = F.coalesce(F.sum("duration_ms").over(before), F.lit(0))
    return chunks.withColumns({"start": F.round(elapsed / 1000, 3), "end": F.round((elapsed + F.col("duration_ms")) / 1000, 3)})


def with_durations(chunks: DataFrame, audio: DataFrame) -> DataFrame:
    """Chunks and the audio of the same place; those beyond the shorter list go."""
    return chunks.join(audio, ["doc_id", "chunk_index"])


def total_length(timing: DataFrame) -> DataFrame:
    """(doc_id, total): where the last chunk ends."""
    return timing.groupBy("doc_id").agg(F.coalesce(F.max_by("end", "chunk_index"), F.lit(0.0)).alias("total"))


def word_timing(timing: DataFrame) -> DataFrame:
    """One row for each token of a chunk; a chunk's time is shared by token length, and no word ends after it."""
    exploded = timing.select("doc_id", "chunk_index", "start", "end", F.posexplode(tokens(F.col("text"))).alias("word_pos", "norm"))
    exploded = exploded.withColumn("weight", F.greatest(F.length("norm"), F.lit(1)))
    chunk = Window.partitionBy("doc_id", "chunk_index")
    upto = chunk.orderBy("word_pos").rowsBetween(Window.unboundedPreceding, 0)
    share = F.greatest(F.col("end") - F.col("start"), F.lit(0.0)) / F.sum("weight").over(chunk)
    until = F.sum("weight").over(upto)
    spoken = exploded.withColumns({"word_start": rounded(F.col("start") + share * (until - F.col("weight")), 3), "word_end": rounded(F.least(F.col("end"), F.col("start") + share * until), 3)})
    return spoken.select("doc_id", "chunk_index", "word_pos", "norm", "word_start", "word_end")


def transcript_words(transcript: DataFrame) -> DataFrame:
    """Recognised words, trimmed, with a token; missing times count as 0, times have 3 places."""
    from readalong.functions.text import normal_token, strip

    named = transcript.withColumn("text", strip(F.col("word"))).withColumn("norm", normal_token(strip(F.col("word")))).filter("norm <> ''")
    order = Window.partitionBy("doc_id").orderBy("seg", "pos")
    return named.select("doc_id", (F.row_number().over(order) - 1).alias("word_idx"), "text", "norm", F.round(F.coalesce("t0", F.lit(0.0)), 3).alias("start"), F.round(F.coalesce("t1", F.lit(0.0)), 3).alias("end"))
