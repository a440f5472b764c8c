"""Crawl files as a stream: listings out of pages, merging them into jobs, and first sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide.operators.extraction import extract_jobs
from jobtide.operators.merging import match_listings, merge_matched
from jobtide.schemas import JOBS
from jobtide.sources.shared import exists, ship_package, written
from jobtide.streaming.sinks import latest_rows, rows_written, write_triggers

_SIGHTING = "company_id bigint, job_url string, seen_at timestamp"
_LISTING = "company_id bigint, job_title string, job_url string, location string, date_posted timestamp, description_preview string, status string"
# Folder of a job, by its URL.
_PART = "url_part"


def listings_stream(pages: DataFrame, companies: DataFrame, site_configs: DataFrame, path: str, checkpoint: str, as_of) -> StreamingQuery:
    """Extract listings from pages as they come (see ``stream_pages``) and write those that are new or changed below ``path``.

    Pages are turned into elements where they lie. A company's first listing of a URL in page and element order counts, whatever
    order pages come in: it is Spark's aggregate state, one row a company and URL, and repeats combine before they move.
    """
    ship_package(pages.sparkSession)
    return write_triggers(extract_jobs(pages, companies, site_configs, as_of), path, checkpoint, "update")


def listings_found(spark: SparkSession, path: str) -> DataFrame:
    """One listing per company and URL, as ``extract_jobs`` gives them for all pages so far."""
    return latest_rows(spark, path, _LISTING, ["company_id", "job_url"])


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("job_url"), F.lit(parts)).cast("int")


def _write_jobs(jobs: DataFrame, path: str, parts: int, files: int, replace: str) -> None:
    """Write ``jobs``, up to ``files`` files a folder; ``replace``: ``static`` for the whole table, ``dynamic`` for the folders that have rows in ``jobs``."""
    dealt = jobs.withColumn(_PART, _part(parts)).repartition(_PART, F.pmod(F.xxhash64("job_id"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(_PART).parquet(f"{path}/jobs")


def upsert_stream(
    listings: DataFrame, jobs: DataFrame, path: str, checkpoint: str, as_of, parts: int = 64, files: int = 4
) -> StreamingQuery:
    """Merge every trigger's listings into the table of jobs below ``path``, which starts with ``jobs``.

    The table is split by a hash of the job URL, by which listings and jobs are matched: a trigger reads the folders of its URLs only and
    overwrites just these. Errors are written beside the table, in a folder a trigger. Merging the same listings once more changes nothing,
    so a trigger that was broken off is simply repeated. ``parts`` stays the same for the life of a table; null URLs have a folder like any other.
    """
    spark = listings.sparkSession
    if not exists(spark, f"{path}/jobs/_SUCCESS"):
        _write_jobs(jobs, path, parts, files, "static")

    def merge(batch: DataFrame, batch_id: int) -> None:
        listed = batch.filter(F.col("job_url") != "")
        touched = [r[0] for r in listed.select(_part(parts)).distinct().collect()]  # at most ``parts`` numbers
        old = _table(spark, path).where(F.col(_PART).isin(touched)).drop(_PART)
        result = merge_matched(old, written(match_listings(old, listed), "matched"), as_of, listed)
        result.errors.write.mode("overwrite").parquet(f"{path}/errors/batch={batch_id}")
        _write_jobs(written(result.jobs, "merged"), path, parts, files, "dynamic")  # read to the end before anything is replaced

    return listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{JOBS}, {_PART} INT").parquet(f"{path}/jobs")


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs after the last trigger."""
    return _table(spark, path).drop(_PART)


def first_seen_stream(sightings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the earliest sighting of each company and URL (columns company_id, job_url, seen_at); those that a trigger changed go below ``path``.

    Repeats combine before the shuffle, so a very common listing is one row a task. Whatever the order of files, the earliest time
    stays, and no key is ever forgotten: the state, in the checkpoint, grows with the keys.
    """
    earliest = sightings.groupBy("company_id", "job_url").agg(F.min(F.col("seen_at").cast("timestamp")).alias("seen_at"))
    return write_triggers(earliest, path, checkpoint, "update")


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """One row per company and URL, with its first sighting."""
    return rows_written(spark, path, _SIGHTING).groupBy("company_id", "job_url").agg(F.min("seen_at").alias("seen_at"))
