"""The registered queries over the driver's tables and the inline inputs."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readalong.functions import text as tx
from readalong.operators import alignment, chunking, cleaning, layout, playback, tables, timeline
from readalong.plans import fixtures
from readalong.sources import io
from readalong.sources.shared import shared_folder
from readalong.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
BOX = ("x0", "y0", "x1", "y1")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_documents, _pages, _conversations, _events, _benchmark = (_table(n) for n in ("documents", "pages", "conversations", "events", "benchmark"))


def marked_up(docs: DataFrame) -> DataFrame:
    """Documents inside markup of every kind, as the plain texts hold hardly any."""
    before = "\n\n---\n\n**Note** on `code` and ![pic](a.png) a [link](http://example.org).<br>\n- first item\n- second item!\n\n| Kind | Share |\n|---|---|\n| prose | most |\n\n"
    parts = [F.lit("# Part "), F.col("doc_id").cast("string"), F.lit(before), F.coalesce("text", F.lit("")), F.lit("\n\n```\nx = 1\n```\n<i>end</i>  of   it\n\n\n\n## References\n[1] left out")]
    return docs.select("doc_id", F.concat(*parts).alias("text"))


def clean_text(spark, sf_dir):
    """Every step of the cleaner, on all documents inside markup."""
    cleaned = cleaning.clean_documents(marked_up(_documents(spark, sf_dir)))
    return cleaned.select("doc_id", "clean_text", "is_empty")


def clean_steps(spark, sf_dir):
    """The text after each step of the cleaner, on inline inputs."""
    found = spark.sql(fixtures.MARKUP)
    text = F.col("text")
    steps = {f"after_{name}": cleaning.without_markup(text, name) for name in ("heading", "rule", "fence", "code", "image", "link", "star", "underscore", "br", "tag")}
    return found.select("doc_id", cleaning.without_references(text).alias("cut"), *[c.alias(n) for n, c in steps.items()], cleaning.clean(text).alias("cleaned"))


def truncate_references(spark, sf_dir):
    """Documents cut at an injected section line."""
    docs = _documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n### Works  cited\nmore\nAppendix\nrest")).alias("text"))
    return docs.select("doc_id", cleaning.without_references(F.col("text")).alias("text"))


def strip_html_pages(spark, sf_dir):
    """Text of all pages without tags."""
    return _pages(spark, sf_dir).select("page_id", cleaning.plain_html(F.coalesce("html", F.lit(""))).alias("text"))


def markdown_tables(spark, sf_dir):
    """Tables as sentences."""
    return spark.sql(fixtures.TABLES).select("doc_id", tables.speak_tables(F.col("text")).alias("text"))


def list_items(spark, sf_dir):
    """List items as sentences."""
    return spark.sql(fixtures.LISTS).select("doc_id", cleaning.speak_list_items(F.col("text")).alias("text"))


def chunk_text(spark, sf_dir):
    """Chunks of all documents."""
    return chunking.chunk_documents(_documents(spark, sf_dir))


def split_long(spark, sf_dir):
    """Clauses of inline sentences in at most 8 characters."""
    return spark.sql(fixtures.CLAUSES).select("doc_id", F.posexplode(chunking.clauses(F.col("text"), 8)).alias("part_index", "part"))


def split_long_documents(spark, sf_dir):
    """Clauses of every document, as one sentence, in parts of the longest chunk's size."""
    rows = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.posexplode(chunking.clauses(F.col("text"), chunking.CHUNK_SIZE + chunking.ALLOWANCE)).alias("part_index", "part"))


def heading_units(spark, sf_dir):
    """Headings end like sentences."""
    return chunking.chunk_documents(spark.sql(fixtures.HEADINGS))


def fingerprint(spark, sf_dir):
    """Line fingerprints and how often they occur, over all documents' lines."""
    rows = _documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy(tx.fingerprint(F.col("line")).alias("fp")).agg(F.count("*").alias("n"))


def _lines_as_blocks(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("ls"))
    rows = docs.select("doc_id", F.size("ls").alias("k"), F.posexplode("ls").alias("pos", "txt"))
    return rows.select("doc_id", F.lit(0).alias("page_index"), "pos", F.col("pos").cast("double").alias("y0"), (F.col("pos") + 1).cast("double").alias("y1"), F.col("k").cast("double").alias("height"), "txt")


def repeated_margins(spark, sf_dir):
    """Repeated margin lines, of documents' lines laid out as blocks and of inline blocks."""
    own = layout.repeated_margins(_lines_as_blocks(spark, sf_dir)).withColumn("origin", F.lit("documents"))
    return own.unionByName(layout.repeated_margins(spark.sql(fixtures.LINES)).withColumn("origin", F.lit("inline")))


def block_filter(spark, sf_dir):
    """Kept blocks and why others go."""
    found = layout.filter_blocks(spark.sql(fixtures.LINES))
    return found.select("doc_id", "page_index", "pos", "kept", "drop_reason")


def assemble_blocks(spark, sf_dir):
    """Text of the kept blocks of each document."""
    return layout.assembled(layout.filter_blocks(spark.sql(fixtures.LINES)))


def reading_order(spark, sf_dir):
    """Blocks in column-aware reading order."""
    return layout.reading_order(spark.sql(fixtures.BLOCKS)).select("doc_id", "page_index", "ordinal", "n_columns", "split", "reading_pos")


def bbox_overlap(spark, sf_dir):
    """Overlap of each block with each region of its page."""
    blocks, found = spark.sql(fixtures.BLOCKS).alias("b"), spark.sql(fixtures.REGIONS).alias("r")
    pairs = blocks.join(found, (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("b.page_index") == F.col("r.page_index")))
    ratio = layout.overlap([F.col(f"b.{c}") for c in BOX], [F.col(f"r.{c}") for c in BOX])
    return pairs.select(F.col("b.doc_id").alias("doc_id"), F.col("b.page_index").alias("page_index"), F.col("b.ordinal").alias("block"), F.col("r.ordinal").alias("region"), F.round(ratio, 6).alias("ratio"))


def layout_keep(spark, sf_dir):
    """Blocks that a kept region covers."""
    found = layout.match_regions(spark.sql(fixtures.BLOCKS), spark.sql(fixtures.REGIONS))
    return found.select("doc_id", "page_index", "ordinal", "n_matches", F.round("best_ratio", 6).alias("best_ratio"), "keep")


def layout_regions(spark, sf_dir):
    """Detections above the confidence, at page scale."""
    found = layout.regions(spark.sql(fixtures.REGIONS))
    return found.select("doc_id", "page_index", "ordinal", "label", *[F.round(c, 6).alias(c) for c in BOX], "keep")


def timed_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of all documents with a declared duration: 120 ms and 55 ms for each character."""
    return timeline.chunk_timing(chunk_text(spark, sf_dir).withColumn("duration_ms", F.lit(120) + F.lit(55) * F.length("text")))


def chunk_timing(spark, sf_dir):
    """Start and end of every chunk."""
    return timed_chunks(spark, sf_dir).select("doc_id", "chunk_index", "start", "end")


def total_length(spark, sf_dir):
    """Length of every document's audio."""
    return timeline.total_length(timed_chunks(spark, sf_dir))


def timed_turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations as chunks, with the same declared durations."""
    turns = _conversations(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    return timeline.chunk_timing(turns.withColumn("duration_ms", F.lit(120) + F.lit(55) * F.length("text")))


def word_timing(spark, sf_dir):
    """Start and end of every word of the conversations."""
    return timeline.word_timing(timed_turns(spark, sf_dir))


def tokenize(spark, sf_dir):
    """Tokens of all documents: how many, how many different, and their text's hash."""
    found = _documents(spark, sf_dir).select("doc_id", tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def word_order(spark, sf_dir):
    """Page words in reading order, with normalised boxes."""
    found = layout.word_order(spark.sql(fixtures.WORDS))
    return found.select("doc_id", "page_index", "ordinal", "word_idx", "norm", *[F.round(c, 6).alias(c) for c in ("nx0", "ny0", "nx1", "ny1")])


def _sequences(spark):
    words = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.split(F.lit(fixtures.SEQUENCES["words"]), " ").alias("words"))
    texts = F.array(*[F.lit(c) for c in fixtures.SEQUENCES["chunks"]])
    chunks = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.posexplode(texts).alias("chunk_index", "text"))
    return chunks.withColumn("chunk", F.split("text", " ")), words


def _matched(found: DataFrame, index: str = "chunk_index") -> DataFrame:
    return found.select("doc_id", F.col("chunk_index").alias(index), F.round("score", 6).alias("score"), "span", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched"))


def match_chunk(spark, sf_dir):
    """Best match of each inline chunk."""
    return _matched(alignment.match_chunks(*_sequences(spark)))


def match_passages(spark, sf_dir):
    """Best match of every benchmark passage in every document's words."""
    own = lambda table, *columns: table.select(*columns, tx.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    passages = own(_benchmark(spark, sf_dir), F.col("item_id").alias("chunk_index")).withColumnRenamed("tokens", "chunk")
    return _matched(alignment.match_passages(passages, own(_documents(spark, sf_dir), "doc_id").withColumnRenamed("tokens", "words")), "item_id")


def in_order(by: str, *order: str):
    """A window over the rows of each ``by`` in order."""
    return Window.partitionBy(by).orderBy(*order)


def printed_words(spark, sf_dir):
    """Words of all turns in order, forty to a page, ten to a line, as an extractor would give them."""
    turns = _conversations(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(tx.tokens(F.coalesce("text", F.lit("")))).alias("pos", "norm"))
    words = turns.withColumn("word_idx", F.row_number().over(in_order("doc_id", "turn", "pos")) - 1)
    k = F.col("word_idx")
    line, column = F.floor(k % 40 / 10), k % 10
    return words.withColumns({"page_index": F.floor(k / 40).cast("int"), "nx0": column / 10.0, "ny0": line / 4.0, "nx1": (column + 1) / 10.0, "ny1": (line + 1) / 4.0})


def _highlights(spark, sf_dir):
    printed = printed_words(spark, sf_dir)
    arrays = alignment.word_arrays(printed)
    chunks = _conversations(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), tx.tokens(F.coalesce("text", F.lit(""))).alias("chunk"))
    return chunks, alignment.highlights(alignment.match_chunks(chunks, arrays), printed)


def highlight_boxes(spark, sf_dir) -> DataFrame:
    """Boxes of conversation turns."""
    return _highlights(spark, sf_dir)[1]


def chunk_highlights(spark, sf_dir):
    """Boxes of conversation turns on pages made of their words."""
    found = _highlights(spark, sf_dir)[1]
    return found.select("doc_id", "chunk_index", "page_index", *[F.round(c, 6).alias(c) for c in ("nx0", "ny0", "nx1", "ny1")], "match_score", "matched_tokens", "query_tokens")


def coverage(spark, sf_dir):
    """Share of turns with a highlight."""
    chunks, found = _highlights(spark, sf_dir)
    return alignment.coverage(chunks, found)


def highlight_payload(spark, sf_dir):
    """Highlights of each conversation as JSON."""
    chunks, found = _highlights(spark, sf_dir)
    return io.payload(found, alignment.coverage(chunks, found))


def word_alignment(spark, sf_dir):
    """Conversation words aligned with a copy that lacks every seventh word."""
    arrays = alignment.word_arrays(printed_words(spark, sf_dir)).withColumnRenamed("words", "tokens")
    fewer = arrays.withColumn("tokens", F.filter("tokens", lambda t, i: i % 7 != 3))
    found = alignment.align_words(arrays, fewer)
    sizes = arrays.select("doc_id", F.size("tokens").cast("long").alias("n_words"))
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n_aligned"), F.sum("spoken_idx").cast("long").alias("spoken_sum"), F.sum("printed_idx").cast("long").alias("printed_sum"))
    return sizes.join(counted, "doc_id").withColumn("coverage", F.round(F.col("n_aligned") * 100.0 / F.col("n_words"), 2))


def words_in_blocks(spark, sf_dir):
    """Words claimed by blocks."""
    found = layout.words_in_blocks(spark.sql(fixtures.WORDS), spark.sql(fixtures.REGIONS))
    return found.select("doc_id", "page_index", "ordinal", "block_pos", "word_idx")


def transcript_words(spark, sf_dir):
    """Recognised words with a token."""
    return timeline.transcript_words(spark.sql(fixtures.TRANSCRIPT).withColumns({c: F.col(c).cast("double") for c in ("t0", "t1")}))


def active_chunk(spark, sf_dir):
    """The chunk that plays at the time of each of 20 probes of a document, or -1."""
    timing = timed_chunks(spark, sf_dir)
    ends = timeline.total_length(timing)
    probes = ends.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("probe_id"), "total")
    probes = probes.select("doc_id", "probe_id", F.round(F.col("total") * (F.col("probe_id") - 1) / 17, 3).alias("t"))
    return playback.active_chunks(probes, timing)


def event_asof(spark, sf_dir):
    """For each click, the latest purchase of its user until then, by event time."""
    events = _events(spark, sf_dir).select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    types = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    both = events.join(F.broadcast(types))
    marks = both.filter("event_type = lo").select("user_id", F.col("t").alias("start"), F.col("event_id").alias("chunk_index"))
    probes = both.filter("event_type = hi").select("user_id", F.col("event_id").alias("probe_id"), "t")
    return playback.active_chunks(probes, marks, "user_id").select("user_id", F.col("probe_id").alias("event_id"), F.col("active").alias("latest"))


def chunk_nav(spark, sf_dir):
    """Previous and next chunk of all documents' chunks, five to a page."""
    chunks = chunk_text(spark, sf_dir).select("doc_id", F.floor(F.col("chunk_index") / 5).cast("int").alias("page_index"), "chunk_index")
    return playback.navigation(chunks)


def clamp_seek(spark, sf_dir):
    """Requests held within their bounds."""
    k = F.col("id")
    asked = spark.range(40).select("id", (k - 10).alias("idx"), (k % 7).alias("n"), (k * 3.5 - 20).alias("seek"), (k * 1.25).alias("duration"), (k / 8.0).alias("zoom"))
    return playback.clamped(asked).select("id", "idx", "seek", "zoom")


def format_time(spark, sf_dir):
    """Times as m:ss."""
    return timed_chunks(spark, sf_dir).select("doc_id", "chunk_index", tx.format_seconds(F.col("end")).alias("label"))


def polygon_percent(spark, sf_dir):
    """Highlight corners in percent of the page."""
    found = _highlights(spark, sf_dir)[1]
    corners = alignment.polygon(F.array("nx0", "ny0", "nx1", "ny1"))
    points = playback.percent_points(corners, F.lit(1.0), F.lit(1.0), F.lit(True))
    return found.select("doc_id", "chunk_index", *[points[k][c].alias(f"p{k}_{n}") for k in range(4) for c, n in ((0, "x"), (1, "y"))])


def page_offset(spark, sf_dir):
    """Highlights of one-page jobs at their place in the file, and the names of the pages' files."""
    results = spark.sql(fixtures.BLOCKS).select("doc_id", F.lit(0).alias("page_index"), F.col("page_index").alias("page_position"), "ordinal")
    merged = playback.merged_pages(results)
    return merged.select("doc_id", "page_index", "ordinal", F.format_string("%s_page_%d.pdf", F.col("doc_id").cast("string"), F.col("page_index") + 1).alias("page_name"))


def progress_stage(spark, sf_dir):
    """Stage, percent and label of progress events."""
    return playback.progress(spark.sql(fixtures.PROGRESS)).select("page_index", "page_count", "phase", "stage", "completed", "percent", "label")


def chunk_state(spark, sf_dir):
    """Chunks before, at and after the third."""
    return chunk_text(spark, sf_dir).groupBy("doc_id", playback.state(F.col("chunk_index"), F.lit(2)).alias("state")).agg(F.count("*").alias("n"))


def safe_filename(spark, sf_dir):
    """Names safe for files, and companion paths, of page addresses and inline names."""
    names = _pages(spark, sf_dir).select(F.col("url").alias("name"), F.lit(None).cast("string").alias("mime")).unionAll(spark.sql(fixtures.FILES))
    safe = tx.safe_filename(F.col("name"), F.lit("upload"))
    return names.select("name", safe.alias("safe"), tx.metadata_path(safe).alias("meta"), tx.is_pdf(F.col("mime"), F.col("name")).alias("is_pdf"))


def scroll(spark, sf_dir):
    """How far to scroll to see each inline block."""
    blocks = spark.sql(fixtures.BLOCKS)
    return blocks.select("doc_id", "page_index", "ordinal", playback.scroll_by(F.col("y0"), F.col("y1"), F.lit(0.0), F.lit(400.0)).alias("by"))


def wav_duration(spark, sf_dir):
    """Seconds of inline audio headers."""

    def wav(frames: int, rate: int) -> bytes:
        body = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16) + struct.pack("<4sI", b"data", 2 * frames)
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body

    rows = [("a.wav", wav(22050, 22050)), ("b.wav", wav(11025, 22050)), ("c.wav", b"RIFF"), ("d.wav", wav(1, 0)), ("e.wav", None)]
    return io.wav_durations(spark.createDataFrame(rows, "path string, content binary"))


def merge_manifest(spark, sf_dir):
    """Manifests of all documents' chunk files."""
    files = chunk_text(spark, sf_dir).select("doc_id", "chunk_index", F.concat(F.lit("audio\\"), io.chunk_key(F.col("doc_id").cast("string"), F.col("chunk_index")), F.lit(".wav")).alias("path"))
    return io.merge_manifest(files)


def job_status(spark, sf_dir):
    """Answers to status requests of the newest run."""
    return jobs.latest_run(jobs.job_status(spark.sql(fixtures.JOBS))).select("job_id", "status", "error", "audio", "has_mp3", "pdf_name", "result_code")


def extract_summary(spark, sf_dir):
    """Cleaned length of every document."""
    cleaned = cleaning.clean_documents(_documents(spark, sf_dir))
    return cleaned.select("doc_id", F.length("clean_text").cast("long").alias("char_count"), "is_empty")


def stream_pages(spark, sf_dir):
    """Chunk counts of documents read as a stream, file by file."""
    base = f"{shared_folder(spark)}/readalong/pages-{uuid.uuid4().hex[:12]}"
    source = _documents(spark, sf_dir)
    source.repartition(4, "doc_id").write.parquet(f"{base}/in")
    jobs.process_stream(spark, f"{base}/in", source.schema, chunking.chunk_documents, f"{base}/out", f"{base}/state", 2)
    return spark.read.parquet(f"{base}/out/rows").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


ALL: tuple[Query, ...] = (
    clean_text, clean_steps, truncate_references, strip_html_pages, markdown_tables, list_items, chunk_text, split_long, split_long_documents, heading_units,
    fingerprint, repeated_margins, block_filter, assemble_blocks, reading_order, bbox_overlap, layout_keep, layout_regions,
    chunk_timing, total_length, word_timing, tokenize, word_order, match_chunk, match_passages, chunk_highlights, coverage, highlight_payload, word_alignment, words_in_blocks, transcript_words,
    active_chunk, event_asof, chunk_nav, clamp_seek, format_time, polygon_percent, page_offset, progress_stage, chunk_state, safe_filename, scroll, wav_duration, merge_manifest, job_status, extract_summary, stream_pages,
)


def queries() -> dict[str, Query]:
    """All queries by name."""
    from readalong.plans import service

    return {q.__name__: q for q in (*ALL, *service.ALL)}
