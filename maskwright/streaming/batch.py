"""Continuous arrival and batch jobs: results by file, progress, downloads and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_done
from ..plans.anonymize import anonymize_files
from ..sources.files import office_files

#: Most files of a job, and seconds that a finished job is kept.
MOST_FILES, KEEP_SECONDS = 50, 3600


def accept_uploads(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Uploads of (job_id, seq, name, size) a job takes: Office files, the first of equal name and size, the first ``most``."""
    from pyspark.sql import Window

    ok = files.filter(F.lower("name").rlike(r"\.(docx|pptx)$"))
    first = ok.groupBy("job_id", "name", "size").agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).filter(F.col("n") <= most).select("job_id", "seq", "name", "size")


def upload_errors(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(job_id, n_files, error) of the jobs that a batch must refuse: with more than ``most`` files, or with no Office file."""
    office = F.count_if(F.lower("name").rlike(r"\.(docx|pptx)$"))
    counts = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_files"), office.alias("_office"))
    error = F.when(F.col("n_files") > most, F.lit(f"more than {most} files")).when(F.col("_office") == 0, F.lit("no file to anonymise"))
    return counts.select("job_id", "n_files", error.alias("error")).filter("error is not null")


def archive_name(job_id: Column, done: Column) -> Column:
    """Name of a job's archive once all its files are done; null before."""
    return F.when(done, F.concat(F.lit("anonymise_"), F.substring(job_id.cast("string"), 1, 8), F.lit(".zip")))


def job_progress(results: DataFrame) -> DataFrame:
    """(job_id, total, done, errors, skipped, success, percent) of rows (job_id, status); status is done, error, skipped or waiting."""
    counts = results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "waiting").alias("done"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return counts.withColumn("success", F.col("done") - F.col("errors") - F.col("skipped")).withColumn("percent", percent_done(F.col("done"), F.col("total")))


def live_jobs(jobs: DataFrame, now, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """Jobs (with created_at) that aren't older than they may get at ``now``."""
    return jobs.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {keep_seconds} seconds"))


def document_versions(runs: DataFrame) -> DataFrame:
    """Number each regeneration of a document: rows (doc_id, ts) get doc_version from 1."""
    from pyspark.sql import Window

    return runs.withColumn("doc_version", F.row_number().over(Window.partitionBy("doc_id").orderBy("ts")))


def watch_folder(spark, folder: str, out: str, checkpoint: str, terms=None, detector=None, scrub_images: bool = False):
    """A stream that anonymises every Office file that arrives in a folder; results are Parquet rows with status and error.

    Each file is handled exactly once by the file sink's log; a bad one is a row, not a failure. Starts at once and stops when what is there is done.
    """
    more = {"detector": detector} if detector else {}
    files = office_files(spark, folder, streaming=True)
    results = anonymize_files(files, terms, scrub_images=scrub_images, **more).withColumn("finished_at", F.current_timestamp())
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
