from pyspark.sql import functions as F

from checks.base import check
from jobtide.operators import reading as R

_SUMMARY = "job_id, company_id, job_title, job_url, location, job_type, status, last_checked"


@check("list_jobs", f"""
SELECT {_SUMMARY} FROM {{jobs}} WHERE status = 'open' AND job_title ILIKE '%engineer%'
ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 20
""")
def list_jobs(d):
    return R.list_jobs(d.view("jobs"), page=2, status="open", search="engineer").items.drop("date_posted")


@check("list_jobs_total", """
SELECT count(*) AS total, 2 AS page, 20 AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages
FROM {jobs} WHERE job_type = 'remote' AND job_title ILIKE '%s_ftware%'
""")
def list_jobs_total(d):
    return R.list_jobs(d.view("jobs"), page=2, job_type="remote", search="s_ftware").info


@check("job_detail", f"""
SELECT {_SUMMARY}, j.created_at, c.company_name, c.career_page_url, c.industry, c.hiring_score
FROM {{jobs}} j JOIN {{companies}} c USING (company_id)
""")
def job_detail(d):
    detail = R.job_detail(d.view("jobs"), d.view("companies"))
    nested = [F.col(f"company.{c}").alias(c) for c in ("company_name", "career_page_url", "industry", "hiring_score")]
    return detail.select(*[c.strip() for c in _SUMMARY.split(",")], "created_at", *nested)


@check("list_companies", """
SELECT company_id, company_name, career_page_url, industry, hiring_score FROM {companies}
WHERE industry = 'BUILDING' AND hiring_score >= 0 AND company_name ILIKE '%customer%'
ORDER BY hiring_score DESC, company_id LIMIT 50
""")
def list_companies(d):
    page = R.list_companies(d.view("companies"), 1, 50, industry="BUILDING", min_score=0, search="customer")
    return page.select("company_id", "company_name", "career_page_url", "industry", "hiring_score")


@check("list_companies_after", """
SELECT company_id, company_name, hiring_score FROM {companies}
WHERE industry = 'BUILDING' AND (hiring_score < 60 OR hiring_score = 60 AND company_id > 20)
ORDER BY hiring_score DESC, company_id LIMIT 100
""")
def list_companies_after(d):
    page = R.list_companies(d.view("companies"), page_size=100, industry="BUILDING", after=(60, 20))
    return page.select("company_id", "company_name", "hiring_score")


@check("company_detail", """
SELECT company_id, company_name, career_page_url, industry, hiring_score, last_job_count FROM {companies} WHERE company_id = 7
""")
def company_detail(d):
    out = R.company_detail(d.view("companies"), 7)
    return out.select("company_id", "company_name", "career_page_url", "industry", "hiring_score", "last_job_count")


@check("company_jobs", f"""
SELECT {_SUMMARY} FROM {{jobs}} WHERE company_id = 7 AND status = 'closed'
""")
def company_jobs(d):
    return R.company_jobs(d.view("jobs"), 7, "closed").drop("date_posted")


@check("site_config_active", "SELECT config_id, job_listing_selector, is_active FROM {site_configs} WHERE company_id = 8 AND is_active")
def site_config_active(d):
    return R.site_config(d.view("site_configs"), 8).select("config_id", "job_listing_selector", "is_active")


@check("company_with_jobs", """
SELECT c.company_id, c.company_name, CAST(p.part AS INT) AS part, 3 AS parts, coalesce(n, 0) AS job_count, coalesce(ids, '') AS job_ids, coalesce(titles, '') AS job_titles
FROM {companies} c CROSS JOIN (SELECT unnest(range(3)) AS part) p LEFT JOIN (
  SELECT company_id, job_id % 3 AS part, count(*) AS n, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS ids,
         string_agg(job_title, ',' ORDER BY job_id) AS titles FROM {jobs} GROUP BY 1, 2) j ON j.company_id = c.company_id AND j.part = p.part
""")
def company_with_jobs(d):
    nested = R.company_with_jobs(d.view("companies"), d.view("jobs"), parts=3)
    return nested.select(
        *("company_id", "company_name", "part", "parts", "job_count"),
        F.array_join(F.col("jobs.job_id").cast("array<string>"), ",").alias("job_ids"),
        F.array_join("jobs.job_title", ",").alias("job_titles"),
    )


@check("hiring_stats", """
SELECT (SELECT count(*) FROM {companies}) AS total_companies, count(*) AS total_jobs,
       count(*) FILTER (status = 'open') AS open_jobs, count(*) FILTER (status = 'closed') AS closed_jobs,
       count(*) FILTER (status = 'unknown') AS unknown_jobs,
       (SELECT string_agg(company_name, ',' ORDER BY hiring_score DESC, company_id)
        FROM (SELECT * FROM {companies} ORDER BY hiring_score DESC, company_id LIMIT 10)) AS top_names
FROM {jobs}
""")
def hiring_stats(d):
    stats = R.hiring_stats(d.view("companies"), d.view("jobs"))
    return stats.withColumn("top_names", F.array_join("top_hiring_companies.company_name", ",")).drop("top_hiring_companies")
