"""Questions of a player: what is active at a time, where next, how far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readalong.functions.text import clamp

#: Phases of a job in order.  Fixed values.
PHASES = {"splitting": 0, "uploading": 1, "processing": 2, "metadata": 3, "done": 4}


def active_chunks(probes: DataFrame, timing: DataFrame, by: str = "doc_id") -> DataFrame:
    """``probes`` (by, probe_id, t) with ``active``: the last chunk that has started, -1 before the first.

    An as-of join: probes and starts share one ordered pass over each key, so no pair is built.  Of equal
    starts the later chunk counts; a probe at a start already sees it.
    """
    marks = timing.select(by, F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("chunk_index").cast("long").alias("idx"), F.lit(None).cast("long").alias("probe_id"))
    asked = probes.select(by, "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"), F.col("probe_id").cast("long").alias("probe_id"))
    order = Window.partitionBy(by).orderBy("t", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(asked).withColumn("active", F.coalesce(F.last("idx", ignorenulls=True).over(order), F.lit(-1)))
    return seen.filter("kind = 1").select(by, "probe_id", "t", "active")


def active_highlights(active: DataFrame, highlights: DataFrame) -> DataFrame:
    """The first highlight of the active chunk, null where it has none."""
    first = Window.partitionBy("doc_id", "chunk_index").orderBy("page_index", "nx0", "ny0")
    one = highlights.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").withColumn("active", F.col("chunk_index").cast("long")).drop("chunk_index")
    return active.join(one, ["doc_id", "active"], "left")


def navigation(chunks: DataFrame) -> DataFrame:
    """Previous and next chunk of every (doc_id, page_index, chunk_index), across the neighbouring page only.

    ``prev_page``/``prev_chunk`` are null at an end or where the neighbouring page has no chunk.
    """
    page = Window.partitionBy("doc_id", "page_index").orderBy("chunk_index")
    ends = chunks.groupBy("doc_id", "page_index").agg(F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"))
    before = ends.select("doc_id", (F.col("page_index") + 1).alias("page_index"), F.col("hi").alias("before"))
    after = ends.select("doc_id", (F.col("page_index") - 1).alias("page_index"), F.col("lo").alias("after"))
    near = chunks.withColumns({"p": F.lag("chunk_index").over(page), "n": F.lead("chunk_index").over(page)}).join(before, ["doc_id", "page_index"], "left").join(after, ["doc_id", "page_index"], "left")
    own = F.col("page_index")
    return near.select(
        "doc_id", "page_index", "chunk_index",
        F.when(F.col("p").isNotNull(), own).when(F.col("before").isNotNull(), own - 1).alias("prev_page"), F.coalesce("p", "before").alias("prev_chunk"),
        F.when(F.col("n").isNotNull(), own).when(F.col("after").isNotNull(), own + 1).alias("next_page"), F.coalesce("n", "after").alias("next_chunk"),
    )


def clamped(requests: DataFrame) -> DataFrame:
    """Chunk index within the list, seek time within the audio, zoom within 0.6 to 2.5."""
    return requests.withColumns({"idx": clamp(F.col("idx"), 0, F.col("n") - 1), "seek": clamp(F.col("seek"), 0.0, F.col("duration")), "zoom": clamp(F.col("zoom"), 0.6, 2.5)})


def percent_points(points: Column, width: Column, height: Column, normalised: Column) -> Column:
    """Points as percent of the page, from shares of it or from page units."""
    return F.transform(points, lambda p: F.array(F.round(F.when(normalised, p[0]).otherwise(p[0] / width) * 100, 4), F.round(F.when(normalised, p[1]).otherwise(p[1] / height) * 100, 4)))


def state(chunk: Column, active: Column) -> Column:
    """A chunk's place relative to the active one."""
    return F.when(chunk == active, "active").when(chunk < active, "past").otherwise("future")


def percent(done: Column, total: Column) -> Column:
    """Percent done, at most 100, 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100.0), done * 100.0 / total)).otherwise(F.lit(0.0))


def progress(events: DataFrame) -> DataFrame:
    """Stage number, completed pages, percent and label of progress events."""
    stage = F.coalesce(*[F.when(F.col("phase") == name, F.lit(k)) for name, k in PHASES.items()], F.lit(0))
    completed = F.when(F.col("phase") == "done", F.col("page_count")).otherwise(F.col("page_index"))
    label = (
        F.when(F.coalesce("page_count", F.lit(0)) == 0, "Preparing pages...")
        .when(F.col("phase") == "done", F.format_string("Completed %d/%d pages", "page_count", "page_count"))
        .otherwise(F.format_string("Page %d/%d", F.col("page_index") + 1, "page_count"))
    )
    return events.withColumns({"stage": stage, "completed": completed, "percent": F.round(percent(completed, F.col("page_count")), 2), "label": label})


def scroll_by(top: Column, bottom: Column, view_top: Column, view_bottom: Column) -> Column:
    """How far to scroll: nothing while the box lies in the view's safe part, else the distance of the middles."""
    lo, hi = view_top + 90, view_bottom - 130
    return F.when((top >= lo) & (bottom <= hi), F.lit(0.0)).otherwise((top + bottom) / 2 - (lo + hi) / 2)


def merged_pages(results: DataFrame) -> DataFrame:
    """Highlights of one-page jobs at their place in the whole file: local page index and the page's own."""
    return results.withColumn("page_index", F.col("page_index") + F.col("page_position"))


def page_sizes(pages: DataFrame) -> DataFrame:
    """Width and height of (.., x0, y0, x1, y1) views, each at least 1; missing corners are 0, 0, 1, 1."""
    side = lambda lo, hi: F.greatest(F.lit(1.0), F.abs(F.coalesce(F.col(hi), F.lit(1.0)) - F.coalesce(F.col(lo), F.lit(0.0))))
    return pages.withColumns({"width": side("x0", "x1"), "height": side("y0", "y1")})


def changed_sizes(known: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``known`` sizes (by, width, height) with those of ``sizes``; ``changed`` says where that made a difference."""
    both = known.withColumnsRenamed({"width": "w", "height": "h"}).join(sizes.select(*by, "width", "height"), by, "full")
    changed = F.col("width").isNotNull() & ~(F.col("width").eqNullSafe(F.col("w")) & F.col("height").eqNullSafe(F.col("h")))
    return both.select(*by, F.coalesce("width", "w").alias("width"), F.coalesce("height", "h").alias("height"), changed.alias("changed"))


def megabytes(size: Column) -> Column:
    """Bytes as MB with two decimals; ties go to the even one, as C's printf rounds, and whole numbers decide them exactly."""
    step = size.cast("long") * 25  # of a hundredth of a MB
    whole = F.shiftright(step, 18)
    rest = step.bitwiseAND((1 << 18) - 1)
    up = (rest > 1 << 17) | ((rest == 1 << 17) & (whole % 2 == 1))
    hundredths = whole + F.when(up, 1).otherwise(0)
    return F.when(size.isNotNull(), F.format_string("%d.%02d MB", F.floor(hundredths / 100), hundredths % 100))


def minutes(seconds: Column) -> Column:
    """Seconds as whole minutes, halves up; null for no audio."""
    return F.when(seconds > 0, F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit("m audio")))


def elapsed(seconds: Column) -> Column:
    """Elapsed seconds as a struct of minutes and seconds."""
    return F.struct(F.floor(seconds / 60).cast("long").alias("mins"), (seconds % 60).cast("long").alias("secs"))


def after_page(pages: DataFrame) -> DataFrame:
    """For each page that ends: the page that plays next, null after the last, and where its pending chunk starts.

    ``pages`` has doc_id, page_index, pending (a chunk asked for, or null) and starts (its chunks' start times).
    The pending chunk is held within the page's chunks; a page without chunks starts nowhere.
    """
    order = Window.partitionBy("doc_id").orderBy("page_index")
    held = F.greatest(F.lit(0), F.least(F.size("starts") - 1, F.col("pending")))
    seek = F.when(F.col("pending").isNotNull() & (F.size("starts") > 0), F.get("starts", held))
    return pages.withColumns({"next_page": F.lead("page_index").over(order), "seek": seek, "autoplay": F.lead("page_index").over(order).isNotNull()})


def page_results(pages: DataFrame, progress_count: Column) -> DataFrame:
    """Page results with missing parts filled in: no timing is an empty one, and the page total falls back on the pages there are."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return pages.withColumns({"chunk_timing": F.coalesce("chunk_timing", F.array().cast("array<double>")), "total_pages": F.when(progress_count > 0, progress_count.cast("long")).otherwise(total)})


def appended(shown: DataFrame, arrived: DataFrame) -> DataFrame:
    """Pages shown so far and one batch more, each page once (the later one), with ``position`` in page order."""
    both = shown.withColumn("_turn", F.lit(0)).unionByName(arrived.withColumn("_turn", F.lit(1)))
    newest = Window.partitionBy("doc_id", "page_index").orderBy(F.desc("_turn"))
    once = both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_turn")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1)
