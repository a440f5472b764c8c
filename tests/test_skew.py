"""One key holds a third of all rows: results stay whole, and the key shrinks before it moves."""

import pytest
from pyspark.sql import functions as F

from jobtide.operators import merging as M
from jobtide.operators import scoring as S
from jobtide.operators.extraction import dedupe_listings
from jobtide.schemas import conform
from jobtide.streaming.changes import status_changes_batch

N = 300_000
HOT = "id % 3 = 0"


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(N, numPartitions=16)


def assert_shrinks_before_it_moves(df):
    """The exchange nearest to the scan of the hot rows comes after a partial aggregate."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan.split("Exchange hashpartitioning")[-1]


def test_history_of_a_hot_job(spark, ids):
    history = conform(
        ids.select(
            F.when(F.expr(HOT), 1).otherwise(F.col("id") % 1000 + 2).alias("job_id"), F.lit("open").alias("old_status"), F.lit("closed").alias("new_status"),
            F.expr("timestamp '2024-06-15 00:00:00'").alias("changed_at"),
        ),
        "job_history",
    )
    jobs = conform(spark.range(1, 1002).select(F.col("id").alias("job_id"), F.lit(7).alias("company_id"), F.lit("closed").alias("status")), "jobs")
    companies = conform(spark.createDataFrame([(7, "A", 0)], "company_id long, company_name string, hiring_score int"), "companies")
    signals = S.company_signals(companies, jobs, history, "2024-06-15 12:00:00")
    assert_shrinks_before_it_moves(signals)
    row = signals.first()
    assert (row.job_updates, row.closed_jobs_delta, row.total_jobs) == (N, N, 1001)


def test_hot_url_listed_again_and_again(ids):
    listings = ids.select(
        F.lit(1).alias("company_id"), F.when(F.expr(HOT), "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("job_url"),
        F.lit(1).alias("page_num"), (N - F.col("id")).cast("int").alias("element_pos"), F.col("id").cast("string").alias("job_title"),
    )
    deduped = dedupe_listings(listings)
    assert_shrinks_before_it_moves(deduped)
    assert deduped.count() == 2 * N // 3 + 1
    assert deduped.filter("job_url = 'hot'").first().job_title == str(N - 3)


def test_hot_url_asked_for_again_and_again(spark, ids):
    asked = ids.select(
        F.col("id").alias("seq"), (F.col("id") % 5).alias("company_id"), F.when(F.expr(HOT), "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("job_url")
    )
    companies = spark.range(1, 5).select(F.col("id").alias("company_id"))
    out = M.insert_checked("jobs", asked, spark.createDataFrame([("u1",)], "job_url string"), companies)
    assert [r.seq for r in out.accepted.filter("job_url = 'hot'").collect()] == [3]
    codes = {r.code: r["count"] for r in out.rejected.groupBy("code").count().collect()}
    assert codes[404] == N // 5 and out.accepted.count() + sum(codes.values()) == N


def test_hot_job_patched_again_and_again(spark, ids):
    patches = ids.select(
        F.when(F.expr(HOT), 1).otherwise(F.col("id") % 1000 + 2).alias("job_id"), F.col("id").alias("seq"), F.lit(True).alias("set_location"),
        F.col("id").cast("string").alias("location"),
    )
    jobs = conform(spark.range(1, 1002).withColumnRenamed("id", "job_id"), "jobs")
    out = M.patch_rows(jobs, patches, "job_id", M.JOB_PATCHABLE, "2024-06-15 12:00:00")
    assert_shrinks_before_it_moves(out)
    assert out.filter("job_id = 1").first().location == str(N - 3)
    assert out.filter("location is null").count() == 0


def test_hot_job_observed_again_and_again(ids):
    seen = ids.select(
        F.when(F.expr(HOT), 1).otherwise(F.col("id") % 1000 + 2).alias("job_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("observed_at"),
        F.when(F.col("id") % 2 == 0, "open").otherwise("closed").alias("status"),
    )
    hot = status_changes_batch(seen).filter("job_id = 1")
    assert hot.count() == N // 3  # every other observation differs from the one before, and the first from unknown
