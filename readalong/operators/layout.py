"""Page blocks: repeated margins, reading order, layout regions.

Every operator joins or groups by (doc_id, page_index) or by document, so a corpus is handled page by page
in parallel; overlap tests are residual conditions of joins on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readalong.functions.text import fingerprint, strip, words

#: Margins as shares of the height, most words of a dropped margin block, default page size.
TOP, BOTTOM, TOP_WORDS, BOTTOM_WORDS = 0.08, 0.88, 20, 35
DEFAULT_WIDTH, DEFAULT_HEIGHT = 600.0, 800.0
#: Two columns where the largest gap of block starts passes this share of the page's width.
COLUMN_GAP = 0.15
#: A block belongs to a region that covers this share of it; a word to a block that covers half of the word.
REGION_OVERLAP, WORD_OVERLAP = 0.35, 0.5
KEPT_LABELS = ("plain text", "title")
PAGE = ("doc_id", "page_index")


def block_text(lines: Column) -> Column:
    """Text of nested lines and spans: spans trimmed and joined by spaces, lines by line ends, empty ones left out."""

    def line(x: Column) -> Column:
        return F.array_join(F.filter(F.transform(x["spans"], lambda s: strip(F.coalesce(s["text"], F.lit("")))), lambda s: s != ""), " ")

    return strip(F.array_join(F.filter(F.transform(lines, line), lambda t: t != ""), "\n"))


def center(y0: Column, y1: Column, height: Column) -> Column:
    """Relative height of a block's middle; a missing or zero height counts as 800."""
    return (y0 + y1) / 2 / F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(DEFAULT_HEIGHT))


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """(doc_id, fp, n): fingerprints of two or more margin blocks of a document (blocks, not pages)."""
    placed = blocks.withColumn("center", center(F.col("y0"), F.col("y1"), F.col("height"))).withColumn("fp", fingerprint(F.col("txt")))
    margin = placed.filter(((F.col("center") < TOP) | (F.col("center") > BOTTOM)) & (F.col("fp") != ""))
    return margin.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).filter("n >= 2")


def filter_blocks(blocks: DataFrame, kept_by_layout: DataFrame | None = None) -> DataFrame:
    """``blocks`` with ``kept`` and ``drop_reason``; the first reason that holds wins.

    ``kept_by_layout`` (doc_id, page_index, pos, keep) has rows for pages with regions only.
    """
    placed = blocks.withColumn("center", center(F.col("y0"), F.col("y1"), F.col("height"))).withColumn("fp", fingerprint(F.col("txt"))).withColumn("n_words", F.size(words(F.col("txt"))))
    placed = placed.join(repeated_margins(blocks).select("doc_id", "fp", F.lit(True).alias("repeated")), ["doc_id", "fp"], "left")
    if kept_by_layout is not None:
        placed = placed.join(kept_by_layout.select(*PAGE, "pos", F.col("keep").alias("laid")), [*PAGE, "pos"], "left")
    else:
        placed = placed.withColumn("laid", F.lit(None).cast("boolean"))
    reason = (
        F.when(~F.coalesce("laid", F.lit(True)), "layout-filter")
        .when(F.coalesce("repeated", F.lit(False)), "repeated-margin")
        .when((F.col("page_index") > 0) & (F.col("center") < TOP) & (F.col("n_words") <= TOP_WORDS), "top-margin")
        .when((F.col("center") > BOTTOM) & (F.col("n_words") <= BOTTOM_WORDS), "bottom-margin")
    )
    return placed.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason").isNull())


def assembled(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): kept blocks joined by blank lines, page by page; pages without any are left out."""
    kept = blocks.filter((F.col("kept")) & (strip(F.col("txt")) != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "pos", "txt"))), lambda b: b["txt"]), "\n\n")
    return kept.groupBy("doc_id").agg(joined.alias("text"))


def columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, n_columns, split): two columns where the largest gap of rounded starts is wide enough."""
    starts = blocks.select(*PAGE, F.bround("x0").alias("x"), "width").groupBy(*PAGE, "x").agg(F.max("width").alias("width"))
    gap = starts.withColumn("gap", F.lead("x").over(Window.partitionBy(*PAGE).orderBy("x")) - F.col("x"))
    widest = gap.groupBy(*PAGE).agg(F.max_by(F.struct("gap", "x"), F.struct("gap", "x")).alias("w"), F.max("width").alias("width"))
    two = F.coalesce(F.col("w.gap") > COLUMN_GAP * F.col("width"), F.lit(False))
    return widest.select(*PAGE, F.when(two, 2).otherwise(1).alias("n_columns"), F.when(two, F.col("w.x") + F.col("w.gap") / 2).alias("split"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their ``reading_pos`` on the page: left column first, then right, each from the top."""
    sided = blocks.join(columns(blocks), list(PAGE)).withColumn("side", F.when(F.col("split").isNull() | (F.col("x0") < F.col("split")), 0).otherwise(1))
    tie = F.when(F.col("split").isNull(), F.col("x0")).otherwise(F.lit(0.0))
    return sided.withColumn("reading_pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("side", "y0", tie, "ordinal")) - 1).drop("side")


def overlap(inner: list[Column], outer: list[Column], least_area: float = 1e-6) -> Column:
    """Share of the inner box that lies in the outer one; boxes are x0, y0, x1, y1."""
    wide = F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0])
    high = F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1])
    area = F.greatest(F.lit(least_area), (inner[2] - inner[0]) * (inner[3] - inner[1]))
    return F.when((wide <= 0) | (high <= 0), F.lit(0.0)).otherwise(wide * high / area)


def regions(detections: DataFrame, confidence: float = 0.20, scale: float = 1.5, labels: tuple[str, ...] = KEPT_LABELS) -> DataFrame:
    """Detected boxes above the confidence, at page scale, with ``keep`` by label."""
    boxes = {c: F.col(c) / scale for c in ("x0", "y0", "x1", "y1")}
    return detections.filter(F.col("confidence") >= confidence).withColumns(boxes).withColumn("keep", F.col("label").isin(*labels))


def match_regions(blocks: DataFrame, found: DataFrame, least: float = REGION_OVERLAP) -> DataFrame:
    """Blocks of pages with regions: how many regions they match, the best ratio, and whether a kept one is among them."""
    box = lambda a: [F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1")]
    pages = found.select(*PAGE).distinct()
    on_page = blocks.join(pages, list(PAGE), "left_semi")
    ratio = overlap(box("b"), box("r"))
    pairs = on_page.alias("b").join(found.alias("r"), (F.col("b.doc_id") == F.col("r.doc_id")) & (F.col("b.page_index") == F.col("r.page_index")) & (ratio >= least), "left")
    keys = [F.col(f"b.{c}").alias(c) for c in (*PAGE, "ordinal")]
    return pairs.groupBy(*keys).agg(F.count("r.label").alias("n_matches"), F.max(F.when(F.col("r.label").isNotNull(), ratio)).alias("best_ratio"), F.coalesce(F.bool_or("r.keep"), F.lit(False)).alias("keep"))


def words_in_blocks(words_: DataFrame, blocks: DataFrame, least: float = WORD_OVERLAP) -> DataFrame:
    """Words claimed by the first block, in block order, that covers half of them; with their place in that order."""
    box = lambda a: [F.col(f"{a}.{c}") for c in ("x0", "y0", "x1", "y1")]
    ratio = overlap(box("w"), box("b"), 1.0)
    pairs = words_.alias("w").join(blocks.alias("b"), (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page_index") == F.col("b.page_index")) & (ratio >= least))
    rows = pairs.select("w.*", F.col("b.ordinal").alias("block_pos"))
    first = Window.partitionBy(*PAGE, "ordinal").orderBy("block_pos")
    claimed = rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    order = Window.partitionBy("doc_id").orderBy("page_index", "block_pos", "block_no", "line_no", "word_no", "y0", "x0", "ordinal")
    return claimed.withColumn("word_idx", F.row_number().over(order) - 1)


def scanned_words(words_: DataFrame) -> DataFrame:
    """Words with a non-empty token in the order of a plain scan: page by page, from the top, then from the left."""
    from readalong.functions.text import normal_token

    named = words_.withColumn("norm", normal_token(F.col("word"))).filter("norm <> ''")
    return named.withColumn("word_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "y0", "x0", "ordinal")) - 1)


def word_order(words_: DataFrame) -> DataFrame:
    """Words with a non-empty token, in reading order: left blocks, those near the middle, right blocks where both sides have some."""
    block = Window.partitionBy(*PAGE, "block_no")
    page = Window.partitionBy(*PAGE)
    boxed = words_.withColumns({"bx0": F.min("x0").over(block), "by0": F.min("y0").over(block), "bx1": F.max("x1").over(block), "first_seen": F.min("ordinal").over(block)})
    middle, gap = F.col("width") * 0.5, F.greatest(F.lit(20.0), F.col("width") * 0.04)
    mid = (F.col("bx0") + F.col("bx1")) * 0.5
    band = F.when(mid < middle - gap, 0).when(mid > middle + gap, 2).otherwise(1)
    sided = boxed.withColumn("band", band)
    two = F.bool_or(F.col("band") == 0).over(page) & F.bool_or(F.col("band") == 2).over(page)
    sided = sided.withColumn("band", F.when(two, F.col("band")).otherwise(0))
    from readalong.functions.text import normal_token

    named = sided.withColumn("norm", normal_token(F.col("word"))).filter("norm <> ''")
    order = Window.partitionBy("doc_id").orderBy("page_index", "band", "by0", "bx0", "first_seen", "line_no", "word_no", "ordinal")
    share = lambda c, size: F.coalesce(F.try_divide(F.col(c), F.col(size)), F.lit(0.0))
    return named.withColumn("word_idx", F.row_number().over(order) - 1).withColumns({"nx0": share("x0", "width"), "ny0": share("y0", "height"), "nx1": share("x1", "width"), "ny1": share("y1", "height")})
