"""The three periodic runs over the state tables.

What a run derives once and uses several times (matches, verdicts, signals) is written to a shared folder; the figures of its report are
gathered on the way.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from jobtide.operators.classification import classify
from jobtide.operators.extraction import listings_of, page_text, scan_listings, unsupported_selectors
from jobtide.operators.merging import (
    apply_validation,
    match_listings,
    merge_matched,
    recount_jobs,
    status_changes,
    touch_companies,
    validation_batch,
)
from jobtide.operators.scoring import apply_signals, company_signals, report_rows
from jobtide.sources.shared import observed, written
from jobtide.sources.tables import append_history, conform_pages, crawled_pages

CRAWL_PAGES = 3


class Run(NamedTuple):
    tables: dict[str, DataFrame]
    report: DataFrame
    errors: DataFrame | None = None
    # names of the tables that the run gave new rows as a whole, and the rows that others got beside those they had
    changed: tuple[str, ...] = ()
    added: dict[str, DataFrame] = {}


def fetch_errors(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """What went wrong before any page was read: company_id and error, for a company without pages, a page number left out before a later one, and
    a page that came with a code from 400 on. Looks at page numbers and codes only."""
    numbers = F.collect_set("page_num")  # as many as a crawl has pages
    per_company = pages.groupBy("company_id").agg(numbers.alias("numbers"), F.collect_set(F.when(F.col("http_status") >= 400, F.col("http_status"))).alias("codes"))
    lost = F.array_except(F.sequence(F.lit(1), F.array_max("numbers")), "numbers")
    found = F.concat(
        F.transform("codes", lambda code: F.concat(F.lit("a page came with code "), code.cast("string"))),
        F.transform(lost, lambda number: F.concat(F.lit("no page "), number.cast("string"))),
    )
    every = companies.select("company_id").join(per_company, "company_id", "left")
    return every.select("company_id", F.explode(F.when(F.col("numbers").isNull(), F.array(F.lit("no page was fetched"))).otherwise(found)).alias("error"))


def crawl_run(tables: dict[str, DataFrame], pages: DataFrame, as_of, max_pages: int = CRAWL_PAGES) -> Run:
    """Extract listings from crawled pages and merge them into jobs; then recount and touch companies.

    Errors name the companies whose crawl failed: no page, a page left out, one with a code from 400 on (its html is not read) or without html, a selector that cannot be
    used (nothing is extracted for them), or a listed URL that several jobs share. They do not count as processed; what their other pages list is merged all the same.
    """
    wanted, companies = crawled_pages(conform_pages(pages), max_pages), tables["companies"]
    lost = fetch_errors(companies, wanted)
    faulty = written(unsupported_selectors(tables["site_configs"]), "selectors")
    usable = wanted.where(F.coalesce(F.col("http_status"), F.lit(0)) < 400).join(faulty.select("company_id").distinct(), "company_id", "left_anti")
    # small beside the html it comes from, which is read once
    scanned = written(scan_listings(usable, companies, tables["site_configs"], as_of), "scanned")
    listings = written(listings_of(scanned), "listings")
    matched, found = observed(match_listings(tables["jobs"], listings), "matched", added=F.count_if(F.col("holders").isNull()))
    merged = merge_matched(tables["jobs"], matched, as_of, listings)
    empty = scanned.where("NOT fetched").select("company_id").distinct().withColumn("error", F.lit("a page has no html"))
    shared = merged.errors.select("company_id", F.concat("error", F.lit(": "), "job_url").alias("error"))
    errors = shared.unionByName(empty).unionByName(faulty).unionByName(lost)
    errors = errors.select(F.lit("crawl").alias("task"), F.col("company_id").cast("string").alias("item"), "error")
    errors, failed = observed(errors, "errors", errors=F.count("*"))
    owners = tables["jobs"].select("company_id").unionByName(merged.inserted.select("company_id"))
    bad = errors.select(F.col("item").cast("long").alias("company_id"), F.lit(True).alias("failed")).distinct()
    touched = touch_companies(recount_jobs(companies, owners), as_of).join(bad, "company_id", "left")
    touched, done = observed(touched, "companies", processed=F.count_if(F.col("failed").isNull()))
    figures = {("crawl", "companies_processed"): done["processed"], ("crawl", "jobs_added"): found["added"], ("crawl", "errors"): failed["errors"]}
    new = {"companies": touched.drop("failed").select(*companies.columns), "jobs": merged.jobs}
    return Run({**tables, **new}, report_rows(companies.sparkSession, figures), errors, tuple(new))


def validation_run(
    tables: dict[str, DataFrame], job_pages: DataFrame, as_of, n: int = 50, responses: DataFrame | None = None
) -> Run:
    """Judge the next batch of jobs by their pages (url, html and perhaps fetched_at). Pages are narrowed to the
    batch before any text is taken out of them. Of several pages of a job the latest with any text counts;
    ``responses`` refer to jobs by posting_id."""
    batch = validation_batch(tables["jobs"], n).select(F.col("job_id").alias("posting_id"), F.col("job_url").alias("url"))
    texts = page_text(job_pages.join(batch, "url")).filter(F.col("text") != "")
    order = F.struct("fetched_at", "text") if "fetched_at" in job_pages.columns else F.col("text")
    texts = texts.groupBy("posting_id").agg(F.max_by("text", order).alias("text"))
    judged = classify(texts, responses).withColumnRenamed("posting_id", "job_id")
    verdicts, seen = observed(judged, "verdicts", judged=F.count("status"), closed=F.count_if(F.col("status") == "closed"))
    jobs = apply_validation(tables["jobs"], verdicts, as_of)
    changes = status_changes(tables["jobs"], verdicts, as_of)
    history = append_history(tables["job_history"], changes)
    report = report_rows(jobs.sparkSession, {("validation", "jobs_validated"): seen["judged"], ("validation", "jobs_closed"): seen["closed"]})
    return Run({**tables, "jobs": jobs, "job_history": history}, report, changed=("jobs",), added={"job_history": changes})


def scoring_run(tables: dict[str, DataFrame], as_of, advance_baseline: bool = False) -> Run:
    """Score every company and write the results back to companies."""
    signals, seen = observed(company_signals(tables["companies"], tables["jobs"], tables["job_history"], as_of), "signals", companies=F.count("*"))
    companies = apply_signals(tables["companies"], signals, as_of, advance_baseline)
    return Run({**tables, "companies": companies}, report_rows(companies.sparkSession, {("scoring", "companies_updated"): seen["companies"]}), changed=("companies",))
