"""Set-wise maintenance of the state tables: every function takes the old rows and returns the new ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.functions.phrases import DEFAULT_CHANGE_REASON
from jobtide.schemas import JOB_TYPES, STATUSES, conform, instant
from jobtide.sources.shared import written

JOB_PATCHABLE = ("job_title", "location", "job_type", "description_preview", "status")
COMPANY_PATCHABLE = ("company_name", "career_page_url", "logo_url", "industry")


class Upsert(NamedTuple):
    jobs: DataFrame
    inserted: DataFrame
    errors: DataFrame


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def new_key(*columns: str) -> Column:
    """Positive 63-bit key from natural columns, so no task has to hand out numbers.

    Two rows may in theory meet on one key; ``quality_report`` counts such keys.
    """
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _empty(column: Column) -> Column:
    return column.isNull() | (column == "")


def match_listings(jobs: DataFrame, listings: DataFrame) -> DataFrame:
    """One row per listed URL with what its listings say and how many jobs hold it (``holders``, null for none).

    Both sides are reduced per URL by aggregates that combine before the shuffle, so a URL repeated millions of
    times never meets in one task.
    """
    order = F.struct("company_id", "job_title")
    first = F.struct("company_id", "job_title", "location", "date_posted", "description_preview")
    listed = listings.filter(~_empty(F.col("job_url")))
    per_url = listed.groupBy("job_url").agg(
        F.min_by(first, order).alias("first"),
        F.max_by("job_title", order).alias("last_title"),
        F.min("job_title").alias("low_title"),
        F.max("job_title").alias("high_title"),
        F.min_by("location", F.when(~_empty(F.col("location")), order)).alias("found_location"),
    )
    known = jobs.groupBy("job_url").agg(F.count("*").alias("holders"), F.min("job_id").alias("job_id"))
    return per_url.join(known, "job_url", "left")


def upsert_jobs(jobs: DataFrame, listings: DataFrame, as_of) -> Upsert:
    """Merge crawled listings into jobs, matching on URL across all companies.

    A new URL becomes a job of the lowest company that lists it, with status unknown. A known job takes the
    title of the last company that lists it, and a location only while it has none. Jobs that are no longer
    listed stay as they are. URLs that several jobs share cannot be matched and come back as errors.
    """
    # kept, inserted and error rows all build on the match, which is worked out once
    return merge_matched(jobs, written(match_listings(jobs, listings), "matched"), as_of, listings)


def merge_matched(jobs: DataFrame, matched: DataFrame, as_of, listings: DataFrame) -> Upsert:
    """The merge itself. Jobs meet the updates on their own key, which is never skewed. Every company that lists a URL which
    several jobs share has an error."""
    now = instant(as_of)
    updates = matched.filter("holders = 1").select("job_id", "last_title", "low_title", "high_title", "found_location")
    retitled = (F.col("low_title") != F.col("job_title")) | (F.col("high_title") != F.col("job_title"))
    located = _empty(F.col("location")) & F.col("found_location").isNotNull()
    changed = F.coalesce(retitled, F.lit(False)) | located
    merged = jobs.join(updates, "job_id", "left").withColumn("_changed", changed)
    kept = merged.withColumns(
        {
            "location": F.when(located, F.col("found_location")).otherwise(F.col("location")),
            "job_title": F.coalesce("last_title", "job_title"),
            "last_checked": F.when(F.col("_changed"), now).otherwise(F.col("last_checked")),
            "updated_at": F.when(F.col("_changed"), now).otherwise(F.col("updated_at")),
        }
    ).select(*jobs.columns)

    fresh = matched.filter("holders is null")
    touched_again = (F.col("low_title") != F.col("high_title")) | (
        _empty(F.col("first.location")) & F.col("found_location").isNotNull()
    )
    inserted = conform(
        fresh.select(
            new_key("first.company_id", "job_url").alias("job_id"),
            "first.company_id",
            F.col("last_title").alias("job_title"),
            "job_url",
            F.coalesce("found_location", "first.location").alias("location"),
            "first.description_preview",
            "first.date_posted",
            F.when(touched_again, now).alias("last_checked"),
            now.alias("created_at"),
            now.alias("updated_at"),
        ),
        "jobs",
    )
    # repeats of a listing combine before they meet the shared URLs
    listed = listings.groupBy("job_url", "company_id").agg(F.lit("several jobs share this URL").alias("error"))
    errors = listed.join(matched.filter("holders > 1").select("job_url"), "job_url", "left_semi")
    return Upsert(kept.unionByName(inserted.select(*jobs.columns)), inserted, errors)


def recount_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Set ``current_job_count`` to the number of jobs of each company."""
    counts = jobs.groupBy("company_id").agg(F.count("*").cast("int").alias("_n"))
    counted = companies.join(counts, "company_id", "left")
    return counted.withColumn("current_job_count", F.coalesce("_n", F.lit(0))).select(*companies.columns)


def touch_companies(companies: DataFrame, as_of) -> DataFrame:
    """Every company counts as checked, even where its crawl failed."""
    return companies.withColumns({"last_checked": instant(as_of), "updated_at": instant(as_of)})


def validation_batch(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The next ``n`` jobs to validate: unknown ones, and open ones never checked."""
    due = (F.col("status") == "unknown") | ((F.col("status") == "open") & F.col("last_checked").isNull())
    return jobs.filter(due).orderBy("job_id").limit(n)


def apply_validation(jobs: DataFrame, verdicts: DataFrame, as_of) -> DataFrame:
    """Take over the verdicts (job_id, status; one a job); jobs without one, as when their page had no text, stay untouched."""
    judged = verdicts.filter(F.col("status").isNotNull()).select("job_id", F.col("status").alias("_verdict"))
    seen = F.col("_verdict").isNotNull()
    return (
        jobs.join(judged, "job_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_verdict", "status"),
                "last_checked": F.when(seen, instant(as_of)).otherwise(F.col("last_checked")),
                "updated_at": F.when(seen, instant(as_of)).otherwise(F.col("updated_at")),
            }
        )
        .select(*jobs.columns)
    )


def status_changes(old_jobs: DataFrame, new_jobs: DataFrame, as_of) -> DataFrame:
    """History rows for jobs whose status differs between two states.

    ``new_jobs`` needs only job_id, status, and optionally method and reason (verdicts fit as they are), so
    callers pass just the rows that may have changed.
    """
    has_method = "method" in new_jobs.columns
    wording = (
        F.concat(F.col("method"), F.lit(": "), F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(DEFAULT_CHANGE_REASON)))
        if has_method
        else F.lit(None).cast("string")
    )
    after = new_jobs.filter(F.col("status").isNotNull()).select(
        "job_id", F.col("status").alias("new_status"), wording.alias("change_reason")
    )
    before = old_jobs.select("job_id", F.col("status").alias("old_status"))
    both = before.join(after, "job_id").filter(~F.col("old_status").eqNullSafe(F.col("new_status")))
    return both.select("job_id", "old_status", "new_status", "change_reason", instant(as_of).alias("changed_at"))


# table -> (column that must be new, what is already there, whether the company must exist)
_INSERT_RULES = {
    "jobs": ("job_url", "Job with this URL already exists", True),
    "companies": ("career_page_url", "Company with this URL already exists", False),
    "site_configs": (None, None, True),
}


# columns that must have text, and the longest texts; what is allowed where only some values are
_REQUIRED = {"jobs": ("job_title", "job_url"), "companies": ("company_name", "career_page_url"), "site_configs": ()}
_LONGEST = {"job_title": 500, "location": 255, "company_name": 255, "industry": 100, "pagination_type": 50}
_ALLOWED = {"status": STATUSES, "job_type": JOB_TYPES}


def _fault(table: str, given: dict[str, Column]) -> Column:
    """What is wrong with the values of a row, null for nothing. ``given``: the columns it has, and when each one counts."""
    found = []
    for name, counts in given.items():
        if name in _REQUIRED[table]:
            found.append(F.when(counts & _empty(F.col(name)), f"{name} is empty"))
        if name in _LONGEST:
            found.append(F.when(counts & (F.length(name) > _LONGEST[name]), f"{name} is too long"))
        if name in _ALLOWED:
            found.append(F.when(counts & ~F.col(name).isin(*_ALLOWED[name]), f"{name} is not allowed"))
    return F.coalesce(*found, F.lit(None).cast("string"))


def decide_inserts(
    table: str, incoming: DataFrame, existing: DataFrame | None = None, companies: DataFrame | None = None
) -> DataFrame:
    """``incoming`` with ``code`` and ``reason``, null for rows to accept one after the other by ``seq``.

    Empty, too long or unknown values are refused first (422); the company must exist (404), the URL must be new (400). Of several
    incoming rows with one URL the earliest that is not refused for another reason wins.
    """
    url, message, needs_parent = _INSERT_RULES[table]
    rows = incoming.withColumn("_fault", _fault(table, {c: F.lit(True) for c in incoming.columns}))
    if needs_parent:
        parents = companies.select("company_id").distinct().withColumn("_parent", F.lit(True))
        rows = rows.join(parents, "company_id", "left")
    else:
        rows = rows.withColumn("_parent", F.lit(True))
    faulty, orphan = F.col("_fault").isNotNull(), F.col("_parent").isNull()
    code = F.when(faulty, 422).when(orphan, 404)
    reason = F.when(faulty, F.col("_fault")).when(orphan, "Company not found")
    if url:
        # One candidate per URL, then back on the unique request number: a hot URL never joins with itself.
        candidates = rows.filter(~faulty & ~orphan).groupBy(url).agg(F.min("seq").alias("seq"))
        winners = candidates.join(existing.select(url).distinct(), url, "left_anti").select("seq", F.lit(True).alias("_won"))
        rows = rows.join(winners, "seq", "left")
        code = code.when(F.col("_won").isNull(), 400)
        reason = reason.when(F.col("_won").isNull(), message)
    return rows.select(*incoming.columns, code.alias("code"), reason.alias("reason"))


def insert_checked(
    table: str, incoming: DataFrame, existing: DataFrame | None = None, companies: DataFrame | None = None
) -> Checked:
    """The two sides of ``decide_inserts``; write its result once where both are used."""
    decided = decide_inserts(table, incoming, existing, companies)
    return Checked(
        decided.filter("code is null").drop("code", "reason"),
        decided.filter("code is not null"),
    )


def created_rows(table: str, accepted: DataFrame, as_of) -> DataFrame:
    """Accepted requests as whole rows of ``table``: with key, defaults and times, ready to be added to it."""
    key, columns = {"jobs": ("job_id", ("company_id", "job_url")), "companies": ("company_id", ("career_page_url",)), "site_configs": ("config_id", ("company_id", "seq"))}[table]
    now = instant(as_of)
    return conform(accepted.withColumns({key: new_key(*columns), "created_at": now, "updated_at": now}), table)


def decide_patches(table: str, rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``patches`` with ``code`` and ``reason``, null for those that ``patch_rows`` may apply: values that are set must be allowed (422),
    and the row must exist (404)."""
    set_columns = [c.removeprefix("set_") for c in patches.columns if c.startswith("set_")]
    fault = _fault(table, {c: F.coalesce(f"set_{c}", F.lit(False)) for c in set_columns})
    known = rows.select(key).distinct().withColumn("_known", F.lit(True))
    decided = patches.withColumn("_fault", fault).join(known, key, "left")
    faulty, unknown = F.col("_fault").isNotNull(), F.col("_known").isNull()
    code, reason = F.when(faulty, 422).when(unknown, 404), F.when(faulty, F.col("_fault")).when(unknown, f"no row has this {key}")
    return decided.select(*patches.columns, code.alias("code"), reason.alias("reason"))


def unknown_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids to delete that no row has."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_anti")


def patch_rows(df: DataFrame, patches: DataFrame, key: str, fields: tuple[str, ...], as_of) -> DataFrame:
    """Partial updates: ``patches`` holds ``key``, and per field ``set_<field>`` and ``<field>``.

    Only fields with their flag set change, and a supplied null is stored as null. With a ``seq`` column
    several patches of a row apply in that order. Rows that really change get new time stamps.
    """
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    fields = tuple(f for f in fields if f"set_{f}" in patches.columns)
    folded = patches.groupBy(key).agg(
        *[F.bool_or(F.coalesce(f"set_{f}", F.lit(False))).alias(f"_set_{f}") for f in fields],
        *[F.max_by(f, F.when(F.col(f"set_{f}"), seq)).alias(f"_new_{f}") for f in fields],
    )
    joined = df.join(folded, key, "left")
    is_set = {f: F.coalesce(f"_set_{f}", F.lit(False)) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | (is_set[f] & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")))
    new = {f: F.when(is_set[f], F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    for stamp in ("last_checked", "updated_at"):
        if stamp in df.columns:
            new[stamp] = F.when(F.col("_changed"), instant(as_of)).otherwise(F.col(stamp))
    return joined.withColumn("_changed", changed).withColumns(new).select(*df.columns)


def delete_cascade(
    tables: dict[str, DataFrame], company_ids: DataFrame | None = None, job_ids: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Drop companies with their jobs, history and configs, and jobs with their history."""
    out = dict(tables)
    gone_jobs = []
    if company_ids is not None:
        ids = company_ids.select("company_id")
        gone_jobs.append(tables["jobs"].join(ids, "company_id", "left_semi").select("job_id"))
        for name in ("companies", "jobs", "site_configs"):
            if name in out:
                out[name] = out[name].join(ids, "company_id", "left_anti")
    if job_ids is not None:
        gone_jobs.append(job_ids.select("job_id"))
        out["jobs"] = out["jobs"].join(job_ids.select("job_id"), "job_id", "left_anti")
    if gone_jobs and "job_history" in out:
        for ids in gone_jobs:
            out["job_history"] = out["job_history"].join(ids, "job_id", "left_anti")
    return {name: df.select(*tables[name].columns) for name, df in out.items()}
