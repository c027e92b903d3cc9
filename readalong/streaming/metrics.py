"""Measures of stages and requests."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

log = logging.getLogger("readalong")


def observed(df: DataFrame, stage: str, text: str = "text") -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows and characters as it runs; nothing is read twice for it."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")), seen


@contextmanager
def timed(stage: str, **facts: object) -> Iterator[dict]:
    """Log a stage's seconds, with ``facts``, as one line of key=value pairs; the dict gets ``seconds``."""
    out: dict = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        log.info("stage=%s seconds=%.3f %s", stage, out["seconds"], " ".join(f"{k}={v}" for k, v in facts.items()))


def stage_counts(stages: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """(stage, rows, chars) of tables that are at hand anyway."""
    counted = [df.agg(F.lit(name).alias("stage"), F.count("*").alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("chars")) for name, df in stages.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionAll(one)
    return out


def latency(events: DataFrame, by: str, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """(by, n, mean_ms, max_ms): time from each event to the next of its key, in milliseconds."""
    order = Window.partitionBy(by).orderBy(at, tie)
    ms = (F.unix_micros(F.lead(at).over(order).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000
    return events.withColumn("ms", ms).groupBy(by).agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.max("ms"), 3).alias("max_ms"))
