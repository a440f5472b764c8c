"""Read queries over companies and jobs."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

JOB_SUMMARY = (
    "job_id", "company_id", "job_title", "job_url", "location", "job_type", "status", "date_posted", "last_checked",
)
COMPANY_SUMMARY = (
    "company_id", "company_name", "career_page_url", "logo_url", "industry", "current_job_count", "hiring_score",
    "last_checked",
)
COMPANY_DETAIL = (*COMPANY_SUMMARY, "last_job_count", "created_at", "updated_at")


class Page(NamedTuple):
    items: DataFrame
    info: DataFrame


def _check_page(page: int, page_size: int) -> int:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1 and page_size lies between 1 and 100")
    return (page - 1) * page_size


def _contains(column: str, search: str) -> Column:
    """Case-blind match anywhere; % and _ in the search text are wildcards, a backslash escapes them."""
    pattern = re.sub(r"\\(?![%_\\])", "", search)
    return F.ilike(F.col(column), F.lit(f"%{pattern}%"))


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def list_jobs(
    jobs: DataFrame,
    page: int = 1,
    page_size: int = 20,
    company_id: int | None = None,
    status: str | None = None,
    job_type: str | None = None,
    search: str | None = None,
    after: tuple | None = None,
) -> Page:
    """One page of jobs, newest first, and a row with total, page, page_size and total_pages.

    Empty filters (company 0, empty text) do not filter. Deep pages are cheaper with ``after``, the
    (created_at, job_id) of the last row seen, than with a page number.
    """
    skip = _check_page(page, page_size)
    tests = []
    if company_id:
        tests.append(F.col("company_id") == company_id)
    if status:
        tests.append(F.col("status") == status)
    if job_type:
        tests.append(F.col("job_type") == job_type)
    if search:
        tests.append(_contains("job_title", search))
    wanted = jobs.filter(_both(tests))
    info = wanted.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total") / page_size).cast("bigint").alias("total_pages"),
    )
    items = wanted
    if after is not None:
        moment, last_id = F.lit(after[0]).cast("timestamp"), after[1]
        items = items.filter((F.col("created_at") < moment) | ((F.col("created_at") == moment) & (F.col("job_id") > last_id)))
    items = items.orderBy(F.desc("created_at"), "job_id").offset(skip).limit(page_size)
    return Page(items.select(*JOB_SUMMARY), info)


def job_detail(jobs: DataFrame, companies: DataFrame, job_id: int | None = None) -> DataFrame:
    """Jobs with their company nested; one job by id, or all."""
    wanted = jobs if job_id is None else jobs.filter(F.col("job_id") == job_id)
    owner = companies.select("company_id", F.struct(*COMPANY_SUMMARY).alias("company"))
    return wanted.join(owner, "company_id", "left").select(
        *JOB_SUMMARY, "description_preview", "created_at", "updated_at", "company"
    )


def list_companies(
    companies: DataFrame,
    page: int = 1,
    page_size: int = 20,
    industry: str | None = None,
    min_score: int | None = None,
    search: str | None = None,
    after: tuple | None = None,
) -> DataFrame:
    """One page of companies by score; a minimum score of 0 does filter. Deep pages are cheaper with ``after``, the (hiring_score, company_id) of the last row seen, than
    with a page number. Companies without a score come last."""
    skip = _check_page(page, page_size)
    tests = []
    if industry:
        tests.append(F.col("industry") == industry)
    if min_score is not None:
        tests.append(F.col("hiring_score") >= min_score)
    if search:
        tests.append(_contains("company_name", search))
    if after is not None:
        score, last_id = F.lit(after[0]).cast("int"), after[1]
        lower = (F.col("hiring_score") < score) | F.col("hiring_score").isNull()
        same = F.col("hiring_score").eqNullSafe(score) & (F.col("company_id") > last_id)
        tests.append(same if after[0] is None else lower | same)
    ranked = companies.filter(_both(tests)).orderBy(F.desc("hiring_score"), "company_id")
    return ranked.offset(skip).limit(page_size).select(*COMPANY_SUMMARY)


def company_detail(companies: DataFrame, company_id: int) -> DataFrame:
    return companies.filter(F.col("company_id") == company_id).select(*COMPANY_DETAIL)


def site_config(site_configs: DataFrame, company_id: int) -> DataFrame:
    """The active selector config of a company."""
    return site_configs.filter((F.col("company_id") == company_id) & F.col("is_active"))


def company_jobs(jobs: DataFrame, company_id: int, status: str | None = None) -> DataFrame:
    wanted = jobs.filter(F.col("company_id") == company_id)
    if status:
        wanted = wanted.filter(F.col("status") == status)
    return wanted.orderBy(F.desc("created_at"), "job_id").select(*JOB_SUMMARY)


def company_with_jobs(companies: DataFrame, jobs: DataFrame, parts: int = 1) -> DataFrame:
    """Companies with their jobs nested as an array ordered by id, in ``parts`` rows each (``part`` from 0).

    Part p holds the jobs whose id leaves p when divided by ``parts``, for every company alike. Choose so many that the jobs of the
    largest company, spread over them, fit into rows.
    """
    part = F.pmod("job_id", F.lit(parts)).cast("int")
    nested = jobs.withColumn("part", part).groupBy("company_id", "part")
    nested = nested.agg(F.array_sort(F.collect_list(F.struct(*JOB_SUMMARY))).alias("jobs"), F.count("*").alias("job_count"))
    every = companies.select(*COMPANY_DETAIL, F.lit(parts).alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    out = every.join(nested, ["company_id", "part"], "left")
    return out.withColumns({"jobs": F.coalesce("jobs", F.array().cast(nested.schema["jobs"].dataType)), "job_count": F.coalesce("job_count", F.lit(0))})


def hiring_stats(companies: DataFrame, jobs: DataFrame, top: int = 10) -> DataFrame:
    """One row: counts of companies and of jobs by status, and the top companies as an array."""
    by_status = jobs.agg(
        F.count("*").alias("total_jobs"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_jobs") for s in ("open", "closed", "unknown")],
    )
    ranked = companies.orderBy(F.desc("hiring_score"), "company_id").limit(top)
    best = ranked.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("hiring_score")).alias("rank"), *COMPANY_SUMMARY))).alias("best")
    ).select(F.transform("best", lambda c: F.struct(*[c[f].alias(f) for f in COMPANY_SUMMARY])).alias("top_hiring_companies"))
    pieces = companies.agg(F.count("*").alias("total_companies"))
    for piece in (by_status, best):
        pieces = pieces.unionByName(piece, allowMissingColumns=True)
    return pieces.agg(*[F.first(c, ignorenulls=True).alias(c) for c in pieces.columns])
