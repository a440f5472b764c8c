"""Hiring activity scores, for one point in time or replayed over many runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jobtide.schemas import instant
from jobtide.sources.shared import written
from jobtide.sources.tables import since

# Score weights.
NEW_JOB = 5
MANY_NEW_JOBS = 10
MANY_NEW_JOBS_FROM = 3
JOB_CLOSED = -5
JOB_UPDATED = 3

UPDATE_HOURS = 24
CLOSURE_HOURS = 48

#: Rows that a task of ``run_deltas`` joins and spreads over runs, or so.
_SPREAD = 2_000_000


def hours_before(as_of, hours: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))


def _is_update() -> Column:
    # Plain <>: a row without an old status is not an update.
    return F.col("old_status") != F.col("new_status")


def job_stats(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Total, open and closed jobs of every company, 0 where it has none."""
    counts = jobs.groupBy("company_id").agg(*_status_counts())
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_jobs", "open_jobs", "closed_jobs")]
    return companies.select("company_id").join(counts, "company_id", "left").select("company_id", *zero)


def _status_counts() -> list[Column]:
    return [
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "open").alias("open_jobs"),
        F.count_if(F.col("status") == "closed").alias("closed_jobs"),
    ]


def _activity(history: DataFrame, as_of, update_hours: int, closure_hours: int) -> DataFrame:
    """Recent updates and closures per job; history shrinks to one row per active job before any join."""
    recent = since(history, hours_before(as_of, max(update_hours, closure_hours)))
    updated = _is_update() & (F.col("changed_at") >= hours_before(as_of, update_hours))
    closed = (F.col("new_status") == "closed") & (F.col("changed_at") >= hours_before(as_of, closure_hours))
    return (
        recent.filter(updated | closed)
        .groupBy("job_id")
        .agg(F.count_if(updated).alias("updates"), F.count_if(closed).alias("closures"))
    )


def recent_updates(jobs: DataFrame, history: DataFrame, as_of, hours: int = UPDATE_HOURS) -> DataFrame:
    """Status changes per company in the last hours; companies without any are absent."""
    per_job = since(history, hours_before(as_of, hours)).filter(_is_update()).groupBy("job_id").agg(F.count("*").alias("n"))
    owned = jobs.select("job_id", "company_id").join(per_job, "job_id")
    return owned.groupBy("company_id").agg(F.sum("n").alias("job_updates"))


def recent_closures(jobs: DataFrame, history: DataFrame, as_of, hours: int = CLOSURE_HOURS) -> DataFrame:
    """Changes to closed per company in the last hours, of jobs that are closed now; several per job all count."""
    closed = since(history, hours_before(as_of, hours)).filter(F.col("new_status") == "closed")
    per_job = closed.groupBy("job_id").agg(F.count("*").alias("n"))
    owned = jobs.filter(F.col("status") == "closed").select("job_id", "company_id").join(per_job, "job_id")
    return owned.groupBy("company_id").agg(F.sum("n").alias("closed_jobs_delta"))


def _points(new_jobs: Column, closures: Column, updates: Column) -> Column:
    bonus = F.when(new_jobs >= MANY_NEW_JOBS_FROM, MANY_NEW_JOBS).otherwise(0)
    return new_jobs * NEW_JOB + bonus + closures * JOB_CLOSED + updates * JOB_UPDATED


def score_delta(df: DataFrame) -> DataFrame:
    """Add new_jobs, score_change and new_score from total_jobs, last_job_count, closed_jobs_delta, job_updates
    and previous_score. A score never falls below 0."""
    new_jobs = F.greatest(F.lit(0), F.col("total_jobs") - F.coalesce("last_job_count", F.lit(0))).cast("bigint")
    return (
        df.withColumn("new_jobs", new_jobs)
        .withColumn("score_change", _points(F.col("new_jobs"), F.col("closed_jobs_delta"), F.col("job_updates")))
        .withColumn("new_score", F.greatest(F.lit(0), F.col("previous_score") + F.col("score_change")).cast("bigint"))
    )


SIGNAL_COLUMNS = (
    "company_id", "company_name", "previous_score", "new_score", "score_change", "total_jobs", "open_jobs",
    "closed_jobs", "new_jobs", "closed_jobs_delta", "job_updates",
)


def company_signals(
    companies: DataFrame,
    jobs: DataFrame,
    history: DataFrame,
    as_of,
    update_hours: int = UPDATE_HOURS,
    closure_hours: int = CLOSURE_HOURS,
    company_id: int | None = None,
) -> DataFrame:
    """All signal fields of every company (or of one; an unknown id gives no row).

    One scan per table: recent history is reduced per job and joined to jobs, jobs are reduced per company
    with map-side combine, and the result meets companies. History folders older than the window are not read.
    """
    if company_id is not None:
        companies = companies.filter(F.col("company_id") == company_id)
        jobs = jobs.filter(F.col("company_id") == company_id)
    active = _activity(history, as_of, update_hours, closure_hours)
    per_company = (
        jobs.select("job_id", "company_id", "status")
        .join(active, "job_id", "left")
        .groupBy("company_id")
        .agg(
            *_status_counts(),
            F.sum(F.when(F.col("status") == "closed", F.col("closures"))).alias("closed_jobs_delta"),
            F.sum("updates").alias("job_updates"),
        )
    )
    counts = ("total_jobs", "open_jobs", "closed_jobs", "closed_jobs_delta", "job_updates")
    facts = companies.select(
        "company_id", "company_name", "last_job_count", F.coalesce("hiring_score", F.lit(0)).cast("bigint").alias("previous_score")
    )
    joined = facts.join(per_company, "company_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return score_delta(joined).select(*SIGNAL_COLUMNS)


def apply_signals(companies: DataFrame, signals: DataFrame, as_of, advance_baseline: bool = False) -> DataFrame:
    """Write scores and counts back to companies.

    By default the baseline of "new jobs" is left where it is, so the same jobs count again on the next run;
    ``advance_baseline`` moves it to the current count.
    """
    found = signals.select("company_id", F.col("total_jobs").alias("_jobs"), F.col("new_score").alias("_score"))
    known = F.col("_score").isNotNull()
    new = {
        "current_job_count": F.coalesce(F.col("_jobs").cast("int"), F.col("current_job_count")),
        "hiring_score": F.coalesce(F.col("_score").cast("int"), F.col("hiring_score")),
        "last_checked": F.when(known, instant(as_of)).otherwise(F.col("last_checked")),
        "updated_at": F.when(known, instant(as_of)).otherwise(F.col("updated_at")),
    }
    if advance_baseline:
        new["last_job_count"] = F.coalesce(F.col("_jobs").cast("int"), F.col("last_job_count"))
    return companies.join(found, "company_id", "left").withColumns(new).select(*companies.columns)


def top_companies(companies: DataFrame, limit: int = 10, min_score: int = 0) -> DataFrame:
    ranked = companies.filter(F.col("hiring_score") >= min_score).orderBy(F.desc("hiring_score"), "company_id")
    return ranked.limit(limit)


def run_deltas(
    jobs: DataFrame,
    history: DataFrame,
    every_hours: int = 1,
    update_hours: int = UPDATE_HOURS,
    closure_hours: int = CLOSURE_HOURS,
) -> DataFrame:
    """Score change of every past run that had any (company_id, run_at, delta), for runs ``every_hours`` apart.

    A run at time t counts the jobs created since the run before it, and the updates and closures whose windows
    still hold t (both ends included); closures are judged by the present status. Events are first counted per
    job and run slot; only those counts are spread over the runs whose windows they fall in. Rows are counted first,
    so that a task spreads about as many whatever the size of the history.
    """
    step = every_hours * 3_600_000_000

    def first_run(moment: str) -> Column:
        micros = F.unix_micros(moment)
        return ((micros + F.pmod(-micros, F.lit(step))) / step).cast("bigint")

    def last_run(moment: str, hours: int) -> Column:
        micros = F.unix_micros(moment) + F.lit(hours * 3_600_000_000)
        return ((micros - F.pmod(micros, F.lit(step))) / step).cast("bigint")

    created = jobs.select("company_id", first_run("created_at").alias("run"), F.lit(1).cast("bigint").alias("new_jobs"))
    span = {
        "first": first_run("changed_at"),
        "last_update": last_run("changed_at", update_hours),
        "last_closure": last_run("changed_at", closure_hours),
    }
    per_job = (
        history.withColumns(span)
        .groupBy("job_id", *span)
        .agg(F.count_if(_is_update()).alias("updates"), F.count_if(F.col("new_status") == "closed").alias("closures"))
    )
    # As many parts as the rows need: jobs and runs are met in one step, which combines a company's counts before they move.
    rows = jobs.count() + history.count() * (1 + max(update_hours, closure_hours) / every_hours)
    parts = max(1, math.ceil(rows / _SPREAD))
    owned = jobs.select("job_id", "company_id", "status").repartition(parts, "job_id").join(per_job.repartition(parts, "job_id"), "job_id")
    runs = F.sequence("first", F.greatest("first", "last_update", "last_closure"))
    spread = owned.withColumn("run", F.explode(runs)).select(
        "company_id",
        "run",
        F.lit(0).cast("bigint").alias("new_jobs"),
        F.when(F.col("run") <= F.col("last_update"), F.col("updates")).otherwise(0).alias("updates"),
        F.when((F.col("status") == "closed") & (F.col("run") <= F.col("last_closure")), F.col("closures")).otherwise(0).alias("closures"),
    )
    events = created.select("*", F.lit(0).alias("updates"), F.lit(0).alias("closures")).unionByName(spread)
    summed = events.groupBy("company_id", "run").agg(*[F.sum(c).alias(c) for c in ("new_jobs", "updates", "closures")])
    delta = _points(F.col("new_jobs"), F.col("closures"), F.col("updates"))
    run_at = F.timestamp_micros(F.col("run") * step)
    return summed.select("company_id", run_at.alias("run_at"), delta.alias("delta")).filter("delta <> 0")


def score_timeline(deltas: DataFrame, initial: DataFrame | None = None, block: str = "month") -> DataFrame:
    """Score after every run: the running sum that stops at 0, in closed form.

    With P_n = s0 + d_1 + .. + d_n the clamped score is P_n - min(0, P_1, .., P_n). Sums and minima are taken
    per company and time block, then over the few blocks of a company, then put together, so the runs of
    a very busy company spread over many tasks.
    """
    runs = deltas.withColumn("block", F.date_trunc(block, "run_at"))
    inside = Window.partitionBy("company_id", "block").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    local = runs.withColumn("sum_here", F.sum("delta").over(inside)).withColumn("low_here", F.min("sum_here").over(inside))
    local = written(local, "timeline")  # used for the blocks and for the runs; working it out means scanning history

    # The block's own sum and lowest partial sum are those of its last run.
    blocks = local.groupBy("company_id", "block").agg(
        F.sum("delta").alias("block_sum"), F.min("low_here").alias("block_low")
    )
    if initial is not None:
        start = initial.select("company_id", F.coalesce("hiring_score", F.lit(0)).cast("bigint").alias("start"))
        blocks = blocks.join(start, "company_id", "left")
    else:
        blocks = blocks.withColumn("start", F.lit(0).cast("bigint"))
    before = Window.partitionBy("company_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("carry", F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("block_sum").over(before), F.lit(0)))
        .withColumn("low_seen", F.min(F.col("carry") + F.col("block_low")).over(before))
        .select("company_id", "block", "carry", "low_seen")
    )
    total = F.col("carry") + F.col("sum_here")
    lowest = F.least(F.lit(0), F.col("low_seen"), F.col("carry") + F.col("low_here"))
    return local.join(carried, ["company_id", "block"]).select(
        "company_id", "run_at", "delta", (total - lowest).cast("bigint").alias("score")
    )


def report_rows(spark: SparkSession, figures: dict[tuple[str, str], int]) -> DataFrame:
    """Figures by task and metric as rows of a report; errors are left out where there are none."""
    rows = [(task, metric, value) for (task, metric), value in figures.items() if value or metric != "errors"]
    return spark.createDataFrame(rows, "task string, metric string, value bigint")


def run_report(
    companies: DataFrame | None = None,
    inserted: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    signals: DataFrame | None = None,
    errors: DataFrame | None = None,
) -> DataFrame:
    """Figures of a run as (task, metric, value); ``errors`` holds (task, item, error) and stays a table of its own."""
    spark = next(df for df in (companies, inserted, verdicts, signals, errors) if df is not None).sparkSession
    report = spark.createDataFrame([], "task string, metric string, value bigint")

    def figure(task, metric, df, value):
        nonlocal report
        row = df.agg(value.cast("bigint").alias("value"))
        report = report.unionByName(row.select(F.lit(task).alias("task"), F.lit(metric).alias("metric"), "value"))

    if companies is not None:
        done = companies
        if errors is not None:
            failed = errors.filter(F.col("task") == "crawl").select(F.col("item").cast("bigint").alias("company_id")).distinct()
            done = companies.join(failed, "company_id", "left_anti")
        figure("crawl", "companies_processed", done, F.count("*"))
    if inserted is not None:
        figure("crawl", "jobs_added", inserted, F.count("*"))
    if verdicts is not None:
        judged = verdicts.filter(F.col("status").isNotNull())
        figure("validation", "jobs_validated", judged, F.count("*"))
        figure("validation", "jobs_closed", judged, F.count_if(F.col("status") == "closed"))
    if signals is not None:
        figure("scoring", "companies_updated", signals, F.count("*"))
    if errors is not None:
        counted = errors.groupBy("task").agg(F.count("*").alias("value"))
        report = report.unionByName(counted.select("task", F.lit("errors").alias("metric"), "value"))
    return report
