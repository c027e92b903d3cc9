"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that would be a different
    folder on every machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("readalong.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="readalong-")
        spark.conf.set("readalong.shared.dir", base)
    return base.rstrip("/")
