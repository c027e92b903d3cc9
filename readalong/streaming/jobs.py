"""Jobs and page-at-a-time processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def job_status(jobs: DataFrame) -> DataFrame:
    """What a status request answers: the error of a failed job, file names of a finished one, nothing else early."""
    done, failed = F.col("status") == "done", F.col("status") == "error"
    return jobs.select(
        "job_id", "run_id", "status",
        F.when(failed, F.col("error")).alias("error"),
        F.when(done, F.coalesce("final_mp3", "final_wav")).alias("audio"),
        F.when(done, F.col("final_mp3").isNotNull()).alias("has_mp3"),
        F.when(done, F.regexp_extract("pdf_path", r"([^/]+)\z", 1)).alias("pdf_name"),
        F.when(F.col("status") == "processing", 400).otherwise(200).alias("result_code"),
    )


def latest_run(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the newest run only; late rows of older runs are ignored."""
    if by:
        return events.withColumn("_newest", F.max("run_id").over(Window.partitionBy(*by))).filter("run_id = _newest").drop("_newest")
    return events.join(events.agg(F.max("run_id").alias("run_id")), "run_id")


def unprocessed(inputs: DataFrame, manifest: DataFrame, key: str = "content_hash") -> DataFrame:
    """Inputs whose content the manifest doesn't have yet."""
    return inputs.join(manifest.select(key), key, "left_anti")


def run_state(finished: Column, failed: Column) -> Column:
    """processing, done or error."""
    return F.when(failed, "error").when(finished, "done").otherwise("processing")


def submitted(inputs: DataFrame, manifest: DataFrame, options: str = "") -> DataFrame:
    """New jobs (job_id, doc_id, content_hash, status) for inputs (doc_id, content_hash) that the manifest lacks.

    The job's id is a digest of document, content and options, so that a request that is repeated is the same job.
    """
    job = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "content_hash", F.lit(options)), 256), 1, 32)
    return unprocessed(inputs, manifest).select(job.alias("job_id"), "doc_id", "content_hash", F.lit("processing").alias("status"))


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``jobs`` after a run with ``results`` (doc_id, error): done, or error with its text; still processing without a result."""
    said = results.select("doc_id", "error", F.lit(True).alias("_ended"))
    both = jobs.drop("status", "error").join(said, "doc_id", "left")
    state = F.when(F.col("_ended").isNull(), "processing").otherwise(run_state(F.lit(True), F.col("error").isNotNull()))
    return both.select("job_id", "doc_id", "content_hash", state.alias("status"), "error")


def polled(events: DataFrame, interval_ms: int = 3000) -> DataFrame:
    """(job_id, status, error, n_polls, waited_ms) of jobs' state changes (job_id, at_ms, status, error), asked for every ``interval_ms``.

    The first poll that sees done or error ends the wait; a job without either is still waited for.
    """
    ended = events.filter(F.col("status").isin("done", "error")).groupBy("job_id").agg(F.min_by(F.struct("status", "error", "at_ms"), F.struct("at_ms", "status")).alias("end"))
    found = events.select("job_id").distinct().join(ended, "job_id", "left")
    turns = F.ceil(F.col("end.at_ms") / interval_ms)
    error = F.when(F.col("end.status") == "error", F.coalesce("end.error", F.concat(F.lit("Page job failed: "), "job_id")))
    return found.select("job_id", F.coalesce("end.status", F.lit("processing")).alias("status"), error.alias("error"), (turns + 1).cast("long").alias("n_polls"), (turns * interval_ms).cast("long").alias("waited_ms"))


def result_reads(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """What reads of a job's results answer: (job_id, what, code, detail, url).

    ``asked`` has job_id and what (status, metadata, highlights, audio or pdf), ``jobs`` job_id, status,
    metadata, highlights, audio (paths, or null).  An unknown job is 404; results of an unfinished one 400.
    """
    both = asked.join(jobs.withColumnRenamed("job_id", "known"), F.col("job_id") == F.col("known"), "left")
    unknown, result = F.col("known").isNull(), F.col("what").isin("metadata", "highlights", "audio")
    early = result & (F.col("status") != "done")
    path = F.when(F.col("what") == "metadata", F.col("metadata")).when(F.col("what") == "highlights", F.col("highlights")).when(F.col("what") == "audio", F.col("audio"))
    missing = result & path.isNull()
    code = F.when(unknown, 404).when(early, 400).when(missing, 404).otherwise(200)
    detail = F.when(unknown, "Job not found").when(early, F.concat(F.lit("Job not done (status: "), "status", F.lit(")"))).when(missing, F.concat(F.lit("No "), "what", F.lit(" in result")))
    url = F.concat(F.lit("/api/v1/jobs/"), "job_id", F.when(F.col("what") == "status", F.lit("")).otherwise(F.concat(F.lit("/"), "what")))
    return both.select("job_id", "what", code.alias("code"), detail.alias("detail"), url.alias("url"))


def process_stream(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1, failed: Callable[[DataFrame], Column] | None = None) -> None:
    """Run ``step`` over every new Parquet file below ``source`` and append the results to ``sink``; ends when none is left.

    Each micro-batch replaces a folder of its own number, so that a batch that is repeated after a failure
    leaves its rows once.  With ``failed``, a column that is a row's error text or null, rows with an error
    leave the others alone: they go to ``<sink>/errors`` and ``step`` gets the rest.  ``<sink>/progress`` has a
    row for each batch: its number, rows and errors.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("_error", failed(batch) if failed else F.lit(None).cast("string"))
        step(judged.filter("_error is null").drop("_error")).write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        judged.filter("_error is not null").select("doc_id", F.col("_error").alias("error")).write.mode("overwrite").parquet(f"{sink}/errors/batch={number}")
        counts = judged.agg(F.count("*").alias("n_rows"), F.count("_error").alias("n_errors"), F.lit("done").alias("phase"))
        counts.write.mode("overwrite").parquet(f"{sink}/progress/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
