"""Sliding counts of updates and closures per company from the history stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide.streaming.sinks import latest_rows, write_triggers

_WINDOWS = "company_id bigint, window_start timestamp, window_end timestamp, updates bigint, closures bigint"


def activity_stream(
    history: DataFrame, jobs: DataFrame, path: str, checkpoint: str, hours: int = 48, slide_hours: int = 1, delay: str = "7 days"
) -> StreamingQuery:
    """Count updates and closures per company in windows of ``hours``, one every ``slide_hours``, and write the counts that a trigger changed below ``path``.

    A closure counts if its job is closed in ``jobs`` when the change is read. Open windows show as they grow. The watermark stays ``delay`` behind the latest
    change of earlier triggers: a change adds to its windows that end after the watermark; those that ended before are final and no longer kept. Changes without a time, or of unknown jobs, are left out.
    Rows combine in each task before they move, so a busy company is a row for each window and task.
    """
    owner = jobs.select("job_id", "company_id", (F.col("status") == "closed").alias("closed"))
    moved = F.coalesce(F.col("old_status") != F.col("new_status"), F.lit(False))
    timed = history.withColumn("changed_at", F.col("changed_at").cast("timestamp")).withWatermark("changed_at", delay)
    slots = timed.join(owner, "job_id").groupBy("company_id", F.window("changed_at", f"{hours} hours", f"{slide_hours} hours"))
    counted = slots.agg(F.count_if(moved).alias("updates"), F.count_if(F.col("closed") & (F.col("new_status") == "closed")).alias("closures"))
    shown = counted.select("company_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "updates", "closures")
    return write_triggers(shown, path, checkpoint, "update")


def activity_windows(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far, of every window that holds a change, also of one that is not over yet."""
    return latest_rows(spark, path, _WINDOWS, ["company_id", "window_start", "window_end"])
