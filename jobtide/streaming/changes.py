"""Status changes from a stream of observations, and the same from a table."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from jobtide.sources.shared import ship_package
from jobtide.streaming.sinks import rows_written, write_triggers

CHANGES = "job_id bigint, old_status string, new_status string, changed_at timestamp, late boolean"
_LAST = "status string, seen_at bigint"
_FOUND = "job_id bigint, old_status string, new_status string, changed_at bigint, late boolean"
# A job nobody has looked at yet.
_START = "unknown"
_DAY = 24 * 3600 * 1_000_000


def _observed(observations: DataFrame) -> DataFrame:
    """A page that could not be fetched says nothing about the status."""
    seen = observations.filter(F.col("status").isNotNull())
    return seen.select("job_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "status")


def _run_ends(batches):
    """Of equal statuses that follow each other within a job's day, the first and the last. All of a day's rows are in one partition."""
    found = list(batches)
    if not found:
        return
    rows = pa.Table.from_batches(found).sort_by([("job_id", "ascending"), ("micros", "ascending"), ("status", "ascending")]).combine_chunks()
    day = pc.floor(pc.divide(pc.cast(rows["micros"], pa.float64()), float(_DAY)))
    same = pa.array([], pa.bool_())
    for column in (rows["job_id"], day, rows["status"]):
        equal = pc.equal(column.slice(1), column.slice(0, max(0, len(column) - 1))).combine_chunks()
        same = equal if not len(same) else pc.and_(same, equal)
    edge = pa.array([False]) if rows.num_rows else pa.array([], pa.bool_())
    inside = pc.and_(pa.concat_arrays([edge, same]), pa.concat_arrays([same, edge]))
    yield from rows.filter(pc.invert(inside)).to_batches()


def _compared(key, frames, state):
    """Changes of one job in a trigger, given its last status and time."""
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["micros", "status"], kind="stable")
    status, seen_at = state.get if state.exists else (_START, None)
    late = rows["micros"] <= seen_at if seen_at is not None else pd.Series(False, index=rows.index)
    fresh = rows[~late]
    before = fresh["status"].shift(fill_value=status)
    changed = fresh["status"] != before
    if len(fresh):
        state.update((fresh["status"].iloc[-1], int(fresh["micros"].iloc[-1])))
    yield pd.DataFrame(
        {
            "job_id": key[0],
            "old_status": pd.concat([before[changed], pd.Series([None] * int(late.sum()), dtype=object)], ignore_index=True),
            "new_status": pd.concat([fresh["status"][changed], rows["status"][late]], ignore_index=True),
            "changed_at": pd.concat([fresh["micros"][changed], rows["micros"][late]], ignore_index=True),
            "late": [False] * int(changed.sum()) + [True] * int(late.sum()),
        }
    )


def status_changes_stream(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a change row whenever a job's observed status differs from the one before, below ``path``.

    The last status and time of each job are Spark's keyed state, in the checkpoint. Before a trigger's rows go to their job they are dealt by
    job and day, and of equal observations in a row only the first and the last go on, so that a busy job hands over a few rows a day.

    Observations without a job or status are left out. One that is not newer than the job's last one of an earlier trigger can change nothing that was written; it
    comes out as ``late``. Of a run of equal ones that began before that moment and ended after it, the end counts.
    """
    ship_package(observations.sparkSession)
    seen = _observed(observations).where("job_id IS NOT NULL AND observed_at IS NOT NULL")
    seen = seen.select("job_id", F.unix_micros("observed_at").alias("micros"), "status")
    dealt = seen.repartition("job_id", F.floor(F.col("micros") / _DAY)).mapInArrow(_run_ends, "job_id bigint, micros bigint, status string")
    found = dealt.groupBy("job_id").applyInPandasWithState(_compared, _FOUND, _LAST, "append", GroupStateTimeout.NoTimeout)
    return write_triggers(found.withColumn("changed_at", F.timestamp_micros("changed_at")), path, checkpoint, "append")


def changes_written(spark: SparkSession, path: str) -> DataFrame:
    return rows_written(spark, path, CHANGES).where("NOT late").select("job_id", "old_status", "new_status", "changed_at")


def late_observations(spark: SparkSession, path: str) -> DataFrame:
    """What came too late to count."""
    return rows_written(spark, path, CHANGES).where("late").select("job_id", F.col("changed_at").alias("observed_at"), F.col("new_status").alias("status"))


def status_changes_batch(observations: DataFrame, block: str = "day") -> DataFrame:
    """The same rows from a table. Each job's history is cut into time blocks that are compared on their own;
    only the last status of a block is handed to the next, so a job with very many observations spreads out."""
    seen = _observed(observations).withColumn("block", F.date_trunc(block, "observed_at"))
    inside = Window.partitionBy("job_id", "block").orderBy("observed_at", "status")
    compared = seen.withColumn("before", F.lag("status").over(inside))

    ends = seen.groupBy("job_id", "block").agg(F.max_by("status", F.struct("observed_at", "status")).alias("end"))
    handed = ends.withColumn("handed", F.coalesce(F.lag("end").over(Window.partitionBy("job_id").orderBy("block")), F.lit(_START)))
    previous = F.coalesce("before", "handed")
    return (
        compared.join(handed.drop("end"), ["job_id", "block"])
        .filter(F.col("status") != previous)
        .select("job_id", previous.alias("old_status"), F.col("status").alias("new_status"), F.col("observed_at").alias("changed_at"))
    )
