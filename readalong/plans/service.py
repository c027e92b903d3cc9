"""Queries of the service around the engine: sources, options, jobs, results, and whole runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readalong.functions import text as tx
from readalong.operators import alignment, chunking, cleaning, layout, playback, tables, timeline
from readalong.options import Options, preflight
from readalong.plans import fixtures, queries, run
from readalong.sources import io
from readalong.sources.shared import shared_folder
from readalong.streaming import jobs, metrics

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/readalong/{name}-{uuid.uuid4().hex[:12]}"


def reader_run(spark, sf_dir):
    """How a run over all documents ends: status, counts, length, and digests of what was made."""
    found = run.run_documents(_documents(spark, sf_dir))
    texts = F.md5(F.array_join(F.transform("chunk_timing", lambda c: c["text"]), "\n"))
    return found.select("doc_id", "status", "error", "char_count", "n_chunks", "total", F.md5("manifest").alias("manifest_md5"), texts.alias("chunks_md5"), "final_wav", "final_mp3")


def reader_coverage(spark, sf_dir):
    """Highlights of a run over conversations, as documents of one text each, on pages made of their words."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(joined.alias("text"))
    return run.highlighted(run.run_documents(docs), queries.printed_words(spark, sf_dir))


def run_options(spark, sf_dir):
    """Every option of a run and its default."""
    return Options().checked().as_rows(spark)


def preflight_check(spark, sf_dir):
    """What each inline job lacks, all at once."""
    return preflight(spark.sql(fixtures.REQUIREMENTS))


def source_requests(spark, sf_dir):
    """Answers to inline requests for a source."""
    return io.resolved_sources(spark.sql(fixtures.REQUESTS), spark.sql(fixtures.KNOWN), "/srv")


def decoded_texts(spark, sf_dir):
    """Inline bytes and all documents' bytes as text, and whether a text is blank."""
    inline = spark.sql(fixtures.BYTES).select("doc_id", F.unhex("h").alias("content"))
    rows = inline.unionAll(_documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).cast("binary")))
    text = io.decoded(F.col("content"))
    return rows.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"), (tx.strip(text) == "").alias("is_blank"))


def read_files(spark, sf_dir):
    """Texts of files, one for each nation, with the keys that a cache goes by."""
    path = _folder(spark, "texts")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit(" lies in region "), F.col("n_regionkey").cast("string")).alias("text"))
    nations.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = io.read_texts(spark, path).filter(F.col("path").endswith(".txt"))
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text", "is_blank", "doc_key", F.col("metadata_path").endswith("_meta.json").alias("has_metadata_path"))


def read_metadata(spark, sf_dir):
    """Whole JSON documents, one for each region, read with a known schema; what they lack is null."""
    path = _folder(spark, "metadata")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    regions.select(F.to_json(F.struct(F.col("r_regionkey").alias("page_index"), F.struct(F.col("r_name").alias("text")).alias("block"))).alias("value")).repartition(3).write.text(path)
    schema = T.StructType([T.StructField("page_index", T.LongType()), T.StructField("block", T.StructType([T.StructField("text", T.StringType()), T.StructField("kept", T.BooleanType())]))])
    found = spark.read.schema(schema).json(path).select("page_index", F.col("block.text").alias("text"), F.col("block.kept").alias("kept"))
    return found


def chunk_files(spark, sf_dir):
    """All documents' chunks, written and read again: how many each has, first and last key."""
    path = _folder(spark, "chunks")
    io.write_chunks(chunking.chunk_documents(_documents(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_key").alias("first_key"), F.max_by("chunk_key", "chunk_index").alias("last_key"))


def source_page_files(spark, sf_dir):
    """One-page files of every document, of 3000 characters a page."""
    files = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("stem"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3000).cast("int").alias("n_pages"))
    return io.source_pages(files.filter("n_pages > 0")).select("stem", "page_index", "page_name")


def cache_skip(spark, sf_dir):
    """Documents whose content no earlier job had; earlier are those with an even id."""
    hashed = _documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return jobs.unprocessed(hashed, hashed.filter("doc_id % 2 = 0").select("content_hash").distinct())


def job_manifest(spark, sf_dir):
    """New jobs for all documents, and how each ends: an empty text is an error of its own job only."""
    docs = queries.marked_up(_documents(spark, sf_dir)).select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    inputs = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    made = jobs.submitted(inputs, inputs.limit(0), "mp3")
    results = cleaning.clean_documents(docs).select("doc_id", F.when(F.col("is_empty"), F.lit(run.EMPTY)).alias("error"))
    return jobs.finished(made, results)


def job_polls(spark, sf_dir):
    """When the poll of inline jobs ends."""
    return jobs.polled(spark.sql(fixtures.STATES))


def result_reads(spark, sf_dir):
    """Answers to reads of inline jobs' results."""
    return jobs.result_reads(spark.sql(fixtures.READS), spark.sql(fixtures.RESULTS))


def stream_progress(spark, sf_dir):
    """Rows and errors of documents that came as a stream, file by file, where blank ones fail alone."""
    base = _folder(spark, "progress")
    source = _documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    source.repartition(4, "doc_id").write.parquet(f"{base}/in")
    blank = lambda df: F.when(tx.strip(F.coalesce(df["text"], F.lit(""))) == "", F.lit(run.EMPTY))
    jobs.process_stream(spark, f"{base}/in", source.schema, chunking.chunk_documents, f"{base}/out", f"{base}/state", 2, blank)
    progress = spark.read.parquet(f"{base}/out/progress").agg(F.sum("n_rows").alias("n"))
    errors = spark.read.schema("doc_id long, error string").parquet(f"{base}/out/errors").agg(F.count("*").alias("n"))
    rows = spark.read.parquet(f"{base}/out/rows").agg(F.count("*").alias("n"))
    named = [df.select(F.lit(name).alias("what"), "n") for name, df in (("documents", progress), ("errors", errors), ("chunks", rows))]
    return named[0].unionAll(named[1]).unionAll(named[2])


def stage_metrics(spark, sf_dir):
    """Rows and characters after each stage over all documents."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cleaned = cleaning.clean_documents(docs).select("doc_id", F.col("clean_text").alias("text"))
    return metrics.stage_counts({"extract": docs, "clean": cleaned, "chunk": chunking.chunk_documents(docs)})


def request_latency(spark, sf_dir):
    """Milliseconds from each event of a user to the next."""
    return metrics.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")


def merge_guard(spark, sf_dir):
    """Manifests of all documents, of which every tenth has no audio: that one's merge fails."""
    docs = _documents(spark, sf_dir)
    chunks = chunking.chunk_documents(docs.filter("doc_id % 10 <> 3"))
    files = chunks.select("doc_id", "chunk_index", F.concat(F.lit("audio/"), io.chunk_key(F.col("doc_id").cast("string"), F.col("chunk_index")), F.lit(".wav")).alias("path"))
    found = io.guarded_merge(docs.select("doc_id"), files)
    return found.select("doc_id", F.md5("manifest").alias("manifest_md5"), "error")


def timed_audio(spark, sf_dir):
    """Chunks of all documents beside the audio of the first three of each: what lies beyond the shorter list goes."""
    chunks = chunking.chunk_documents(_documents(spark, sf_dir))
    audio = chunks.filter("chunk_index < 3").select("doc_id", "chunk_index", (F.length("text") * 55 + 120).alias("duration_ms"))
    return timeline.chunk_timing(timeline.with_durations(chunks, audio)).select("doc_id", "chunk_index", "start", "end")


def nested_text(spark, sf_dir):
    """Text of all documents, as nested lines and spans of an extractor."""
    spans = lambda line: F.struct(F.transform(F.split(line, " "), lambda w: F.struct(F.concat(F.lit(" "), w).alias("text"))).alias("spans"))
    blocks = _documents(spark, sf_dir).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), spans).alias("lines"))
    return blocks.select("doc_id", F.md5(layout.block_text(F.col("lines"))).alias("text_md5"))


def _laid_out(spark) -> DataFrame:
    """Inline blocks kept or dropped by the regions of their pages, then by margins."""
    blocks = spark.sql(fixtures.LAID)
    kept = layout.match_regions(blocks, spark.sql(fixtures.REGIONS)).withColumnRenamed("ordinal", "pos")
    return layout.filter_blocks(blocks.withColumn("pos", F.col("ordinal")), kept)


def layout_filter(spark, sf_dir):
    """Why inline blocks on pages with regions go."""
    return _laid_out(spark).select("doc_id", "page_index", "pos", "kept", "drop_reason")


def extract_layout(spark, sf_dir):
    """Text of inline documents after regions, margins and the order of columns."""
    ordered = layout.reading_order(_laid_out(spark).drop("pos")).withColumnRenamed("reading_pos", "pos")
    return layout.assembled(ordered)


def spoken_tables(spark, sf_dir):
    """All documents' lines as rows of tables, said as sentences."""
    row = lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(" |"))
    rows = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), row), "\n")
    text = F.concat(F.lit("Before\n| No | Line |\n|---|:--|\n"), rows, F.lit("\nafter"))
    return _documents(spark, sf_dir).select("doc_id", tables.speak_tables(text).alias("text"))


def spoken_lists(spark, sf_dir):
    """All documents' lines as list items, said as sentences."""
    items = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("- "), x)).when(i % 3 == 1, F.concat((i + 1).cast("string"), F.lit(") "), x)).otherwise(x)), "\n")
    return _documents(spark, sf_dir).select("doc_id", cleaning.speak_list_items(items).alias("text"))


def scanned_words(spark, sf_dir):
    """Inline words, and all conversations' printed words in mixed order, as a plain scan gives them."""
    columns = ("doc_id", "page_index", "ordinal", "x0", "y0", "word")
    printed = queries.printed_words(spark, sf_dir)
    mixed = printed.select((F.col("doc_id") + 1000).alias("doc_id"), "page_index", (F.lit(0) - F.col("word_idx")).alias("ordinal"), (F.col("nx0") * 600).alias("x0"), (F.col("ny0") * 800).alias("y0"), F.col("norm").alias("word"))
    return layout.scanned_words(spark.sql(fixtures.WORDS).select(*columns).unionAll(mixed)).select("doc_id", "page_index", "ordinal", "word_idx", "norm")


def document_order(spark, sf_dir):
    """Reading order of all documents' lines as blocks of two columns, forty to a page."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "txt"))
    k = F.col("k") % 40
    blocks = lines.select("doc_id", F.floor(F.col("k") / 40).cast("int").alias("page_index"), k.alias("ordinal"), F.when(k % 2 == 0, 320.0).otherwise(50.0).alias("x0"), (k * 19.0).alias("y0"), F.lit(600.0).alias("width"))
    return layout.reading_order(blocks).select("doc_id", "page_index", "ordinal", "n_columns", "split", "reading_pos")


def _spoken(spark, sf_dir) -> DataFrame:
    """Words said in conversations: recognised ones for every third, which lack each seventh word, estimated ones else."""
    timed = timeline.word_timing(queries.timed_turns(spark, sf_dir))
    order = F.row_number().over(queries.in_order("doc_id", "chunk_index", "word_pos")) - 1
    estimated = timed.select("doc_id", order.alias("word_idx"), "norm", F.col("word_start").alias("start"), F.col("word_end").alias("end"))
    recognised = estimated.filter("doc_id % 3 = 0 and word_idx % 7 <> 3")
    return alignment.spoken_words(recognised, estimated)


def timing_source(spark, sf_dir):
    """Where the words of each conversation come from, said and printed, and how many."""
    spoken = _spoken(spark, sf_dir).groupBy("doc_id", "timing_source").agg(F.count("*").alias("n_spoken"), F.round(F.max("end"), 3).alias("last_end"))
    scanned = queries.printed_words(spark, sf_dir).select("doc_id", "word_idx", "norm")
    pages = alignment.page_words(scanned.filter("doc_id % 2 = 0"), scanned).groupBy("doc_id", "word_source").agg(F.count("*").alias("n_printed"))
    return spoken.join(pages, "doc_id")


def alignment_payload(spark, sf_dir):
    """Alignment of each conversation's words as JSON."""
    spoken = _spoken(spark, sf_dir)
    one = alignment.word_arrays(spoken).join(spoken.groupBy("doc_id").agg(F.max("timing_source").alias("timing_source")), "doc_id")
    two = alignment.word_arrays(queries.printed_words(spark, sf_dir))
    pairs = alignment.align_words(one.select("doc_id", F.col("words").alias("tokens")), two.select("doc_id", F.col("words").alias("tokens")))
    held = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("spoken_idx", "printed_idx"))).alias("words"))
    sizes = one.select("doc_id", "timing_source", F.size("words").alias("spoken_word_count")).join(two.select("doc_id", F.size("words").alias("pdf_word_count")), "doc_id")
    return io.alignment_payload(sizes.join(held, "doc_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<spoken_idx:int,printed_idx:int>>"))))


def active_highlight(spark, sf_dir):
    """The box of the turn that plays at the time of each of ten probes of a conversation, null where it has none."""
    timing = queries.timed_turns(spark, sf_dir)
    probes = timeline.total_length(timing).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("probe_id"), "total")
    probes = probes.select("doc_id", "probe_id", F.round(F.col("total") * (F.col("probe_id") - 1) / 7, 3).alias("t"))
    found = playback.active_highlights(playback.active_chunks(probes, timing), queries.highlight_boxes(spark, sf_dir))
    return found.select("doc_id", "probe_id", "active", "page_index", *[F.round(c, 6).alias(c) for c in ("nx0", "ny0", "nx1", "ny1")])


def page_append(spark, sf_dir):
    """All documents' pages of five chunks, where odd ones came after even ones, and page 0 twice."""
    chunks = chunking.chunk_documents(_documents(spark, sf_dir))
    pages = chunks.groupBy("doc_id", F.floor(F.col("chunk_index") / 5).cast("int").alias("page_index")).agg(F.count("*").alias("n_chunks"))
    shown = pages.filter("page_index % 2 = 0").withColumn("turn", F.lit(0))
    arrived = pages.filter("page_index % 2 = 1 or page_index = 0").withColumn("turn", F.lit(1))
    return playback.appended(shown, arrived)


def page_size(spark, sf_dir):
    """Sizes of inline page views, and which differ from what was known."""
    sizes = playback.page_sizes(spark.sql(fixtures.VIEWS))
    return playback.changed_sizes(spark.sql(fixtures.SIZES), sizes, ["page_index"])


def unit_display(spark, sf_dir):
    """Bytes of all documents as MB, and the length of their audio as minutes."""
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    return docs.select("doc_id", playback.megabytes(F.col("n").cast("long") * 1000).alias("size"), playback.minutes(F.col("n") / 16).alias("audio"))


def elapsed_split(spark, sf_dir):
    """Elapsed seconds as minutes and seconds."""
    return spark.range(0, 4000, 37).select("id", playback.elapsed(F.col("id")).alias("e")).select("id", "e.mins", "e.secs")


def auto_advance(spark, sf_dir):
    """The page that plays after each page of all documents' chunks, and where a pending chunk starts."""
    timed = queries.timed_chunks(spark, sf_dir).withColumn("page_index", F.floor(F.col("chunk_index") / 5).cast("int"))
    starts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "start"))), lambda c: c["start"])
    pages = timed.groupBy("doc_id", "page_index").agg(starts.alias("starts")).withColumn("pending", F.when(F.col("page_index") % 2 == 0, F.col("page_index") + F.lit(2)))
    return playback.after_page(pages).select("doc_id", "page_index", "next_page", "autoplay", "seek")


def null_defaults(spark, sf_dir):
    """Inline page results with their missing parts filled in."""
    pages = spark.sql(fixtures.RESULT_PAGES).withColumn("chunk_timing", F.when(F.col("first_start").isNotNull(), F.array(F.col("first_start").cast("double"))))
    found = playback.page_results(pages, F.col("page_count"))
    return found.select("doc_id", "page_index", F.size("chunk_timing").alias("n_timing"), "total_pages")


ALL: tuple[Query, ...] = (
    reader_run, reader_coverage, run_options, preflight_check, source_requests, decoded_texts, read_files, read_metadata, chunk_files, source_page_files, cache_skip, job_manifest, job_polls,
    result_reads, stream_progress, stage_metrics, request_latency, merge_guard, timed_audio, nested_text, layout_filter, extract_layout, spoken_tables, spoken_lists, document_order, scanned_words,
    timing_source, alignment_payload, active_highlight, page_append, page_size, unit_display, elapsed_split, auto_advance, null_defaults,
)
