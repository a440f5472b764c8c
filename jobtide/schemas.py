"""Declared table layouts, allowed values and defaults of the stored model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Allowed status and job type names.
STATUSES = ("open", "closed", "unknown")
JOB_TYPES = ("remote", "hybrid", "onsite", "unknown")

COMPANIES = (
    "company_id BIGINT, company_name STRING, career_page_url STRING, logo_url STRING, industry STRING, "
    "last_job_count INT, current_job_count INT, hiring_score INT, "
    "last_checked TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
JOBS = (
    "job_id BIGINT, company_id BIGINT, job_title STRING, job_url STRING, location STRING, job_type STRING, "
    "description_preview STRING, status STRING, date_posted TIMESTAMP, "
    "last_checked TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
JOB_HISTORY = (
    "job_id BIGINT, old_status STRING, new_status STRING, change_reason STRING, changed_at TIMESTAMP"
)
SITE_CONFIGS = (
    "config_id BIGINT, company_id BIGINT, job_listing_selector STRING, job_title_selector STRING, "
    "job_url_selector STRING, job_location_selector STRING, job_date_selector STRING, pagination_type STRING, "
    "next_page_selector STRING, wait_for_selector STRING, load_more_button_selector STRING, is_active BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
CRAWLED_PAGES = (
    "company_id BIGINT, url STRING, page_num INT, http_status INT, html STRING, fetched_at TIMESTAMP"
)
RESPONSES = ("posting_id BIGINT, provider STRING, http_status INT, body STRING")

TABLES = {
    "companies": COMPANIES,
    "jobs": JOBS,
    "job_history": JOB_HISTORY,
    "site_configs": SITE_CONFIGS,
}

# Columns without which a stored table cannot be used.
KEYS = {
    "companies": ("company_id",),
    "jobs": ("job_id",),
    "job_history": ("job_id",),
    "site_configs": ("config_id",),
}

_DEFAULTS = {
    "companies": {"last_job_count": 0, "current_job_count": 0, "hiring_score": 0},
    "jobs": {"status": "unknown", "job_type": "unknown"},
    "job_history": {},
    "site_configs": {"pagination_type": "none", "is_active": True},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Give ``df`` exactly the declared columns of ``table``; absent ones become null, then defaults apply."""
    defaults = _DEFAULTS[table]

    def column(field: str) -> Column:
        name, kind = field.split()
        value = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        return value.alias(name)

    return df.select(*[column(f) for f in TABLES[table].split(", ")])


def instant(value) -> Column:
    """An explicit point in time; text is read in the session time zone."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")
