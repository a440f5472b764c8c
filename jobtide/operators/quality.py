"""Rule violations in the state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.operators.extraction import unsupported_selectors
from jobtide.schemas import JOB_TYPES, STATUSES


def _missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def _longer(column: str, limit: int) -> Column:
    return F.length(column) > limit


# Row rules, all of one table counted in a single pass.
ROW_RULES = {
    "companies": {
        "companies.company_name required": lambda: _missing("company_name"),
        "companies.career_page_url required": lambda: _missing("career_page_url"),
        "companies.company_name length": lambda: _longer("company_name", 255),
        "companies.industry length": lambda: _longer("industry", 100),
    },
    "jobs": {
        "jobs.job_title required": lambda: _missing("job_title"),
        "jobs.job_url required": lambda: _missing("job_url"),
        "jobs.job_title length": lambda: _longer("job_title", 500),
        "jobs.location length": lambda: _longer("location", 255),
        "jobs.status allowed": lambda: ~F.col("status").isin(*STATUSES) | F.col("status").isNull(),
        "jobs.job_type allowed": lambda: ~F.col("job_type").isin(*JOB_TYPES) | F.col("job_type").isNull(),
    },
    "job_history": {
        "job_history.old_status allowed": lambda: ~F.col("old_status").isin(*STATUSES),
        "job_history.new_status allowed": lambda: ~F.col("new_status").isin(*STATUSES) | F.col("new_status").isNull(),
    },
    "site_configs": {
        "site_configs.pagination_type length": lambda: _longer("pagination_type", 50),
    },
}


def _row_violations(df: DataFrame, rules) -> DataFrame:
    counts = df.agg(*[F.count_if(rule()).alias(name) for name, rule in rules.items()])
    columns = [F.col(f"`{name}`") for name in rules]
    return counts.unpivot([], columns, "rule", "violations")


def _count(rule: str, df: DataFrame, rows: Column | None = None) -> DataFrame:
    total = F.coalesce(F.sum(rows), F.lit(0)) if rows is not None else F.count("*")
    return df.agg(total.cast("bigint").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _repeated(rule: str, df: DataFrame, *key: str) -> DataFrame:
    return _count(rule, df.groupBy(*key).count().filter("count > 1"))


def _orphans(rule: str, children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children are counted per key first, so a parent with very many of them stays one row in the join."""
    counted = children.groupBy(key).agg(F.count("*").alias("_n"))
    return _count(rule, counted.join(parents.select(key).distinct(), key, "left_anti"), F.col("_n"))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rule with its violations: rows for row and orphan rules, groups for uniqueness rules, companies for selectors that the page scan cannot use."""
    companies, jobs, history, configs = (tables[t] for t in ("companies", "jobs", "job_history", "site_configs"))
    parts = [_row_violations(tables[t], rules) for t, rules in ROW_RULES.items()]
    parts += [
        _repeated("companies.company_id unique", companies, "company_id"),
        _repeated("jobs.job_id unique", jobs, "job_id"),
        _repeated("jobs.company_id+job_url unique", jobs, "company_id", "job_url"),
        _repeated("site_configs.one active per company", configs.filter("is_active"), "company_id"),
        _count("site_configs.selectors usable", unsupported_selectors(configs).select("company_id").distinct()),
        _orphans("jobs.company_id known", jobs, companies, "company_id"),
        _orphans("job_history.job_id known", history, jobs, "job_id"),
        _orphans("site_configs.company_id known", configs, companies, "company_id"),
    ]
    return reduce(DataFrame.unionByName, parts)
