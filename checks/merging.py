from pyspark.sql import functions as F

from checks.base import AS_OF, check
from jobtide.operators import merging as M
from jobtide.operators.quality import quality_report as report

# Known jobs: those created before 1999, plus some that share the URL of another one.
KNOWN = """
SELECT job_id, company_id, job_title, job_url, location, job_type, status, last_checked, created_at
FROM {jobs} WHERE created_at < TIMESTAMP '1999-01-01 00:00:00'
UNION ALL SELECT job_id + 1000000000, company_id + 7, job_title, job_url, location, job_type, status, last_checked, created_at
FROM {jobs} WHERE created_at < TIMESTAMP '1996-01-01 00:00:00' AND job_type = 'hybrid'"""
# A crawl that sees every job, some with a new title or a location, and remote ones at a second company too.
CRAWL = """
SELECT company_id, CASE WHEN job_id % 6 = 0 THEN concat(job_title, ' (m/f/d)') ELSE job_title END AS job_title, job_url,
       CASE WHEN job_id % 7 = 0 THEN NULL WHEN location IS NULL THEN 'Anywhere' ELSE location END AS location
FROM {jobs}
UNION ALL SELECT company_id + 1, concat(job_title, ' II'), job_url, 'Second office' FROM {jobs} WHERE job_type = 'remote'"""
MERGED = f"""
known AS ({KNOWN}), crawl AS ({CRAWL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY company_id, job_title) AS i,
                  row_number() OVER (PARTITION BY job_url ORDER BY company_id DESC, job_title DESC) AS back FROM crawl),
located AS (SELECT job_url, location, row_number() OVER (PARTITION BY job_url ORDER BY company_id, job_title) AS i
            FROM crawl WHERE location <> ''),
urls AS (
  SELECT f.job_url, f.company_id AS first_company, f.location AS first_location, l.job_title AS last_title,
         p.location AS found_location, s.titles, s.some_title
  FROM ranked f JOIN ranked l ON f.job_url = l.job_url AND l.back = 1
  LEFT JOIN located p ON p.job_url = f.job_url AND p.i = 1
  JOIN (SELECT job_url, count(DISTINCT job_title) AS titles, min(job_title) AS some_title FROM crawl GROUP BY job_url) s ON s.job_url = f.job_url
  WHERE f.i = 1),
holders AS (SELECT job_url, count(*) AS n FROM known GROUP BY job_url),
kept AS (
  SELECT k.job_url, k.company_id, k.status, k.job_type, k.created_at,
         CASE WHEN u.job_url IS NULL THEN k.job_title ELSE u.last_title END AS job_title,
         CASE WHEN coalesce(k.location, '') = '' AND u.found_location IS NOT NULL THEN u.found_location ELSE k.location END AS location,
         CASE WHEN u.titles > 1 OR u.some_title <> k.job_title OR (coalesce(k.location, '') = '' AND u.found_location IS NOT NULL)
              THEN TIMESTAMP '{AS_OF}' ELSE k.last_checked END AS last_checked
  FROM known k LEFT JOIN (SELECT urls.* FROM urls JOIN holders h USING (job_url) WHERE h.n = 1) u ON u.job_url = k.job_url),
added AS (
  SELECT u.job_url, first_company AS company_id, 'unknown' AS status, 'unknown' AS job_type, TIMESTAMP '{AS_OF}' AS created_at,
         last_title AS job_title, coalesce(found_location, first_location) AS location,
         CASE WHEN titles > 1 OR (coalesce(first_location, '') = '' AND found_location IS NOT NULL) THEN TIMESTAMP '{AS_OF}' END AS last_checked
  FROM urls u LEFT JOIN holders h USING (job_url) WHERE h.n IS NULL)
"""
_SHOWN = "job_url, company_id, job_title, location, job_type, status, last_checked, created_at"


def _conformed(d, sql):
    from jobtide.schemas import conform

    return conform(d.sql(sql), "jobs")


def _crawl(d):
    nothing = {"date_posted": F.lit(None).cast("timestamp"), "description_preview": F.lit(None).cast("string")}
    return d.sql(CRAWL).withColumns(nothing)


@check("upsert_jobs", f"WITH {MERGED} SELECT {_SHOWN} FROM kept UNION ALL SELECT {_SHOWN} FROM added")
def upsert_jobs(d):
    return M.upsert_jobs(_conformed(d, KNOWN), _crawl(d), AS_OF).jobs.select(*_SHOWN.split(", "))


@check("upsert_errors", f"WITH {MERGED} SELECT DISTINCT job_url, company_id FROM crawl JOIN holders USING (job_url) WHERE n > 1")
def upsert_errors(d):
    return M.upsert_jobs(_conformed(d, KNOWN), _crawl(d), AS_OF).errors.drop("error")


@check("recount_jobs", """
SELECT c.company_id, CAST(coalesce(n, 0) AS INT) AS current_job_count FROM {companies} c
LEFT JOIN (SELECT company_id, count(*) AS n FROM {jobs} GROUP BY company_id) j USING (company_id)
""")
def recount_jobs(d):
    return M.recount_jobs(d.view("companies"), d.view("jobs")).select("company_id", "current_job_count")


@check("touch_companies", f"SELECT company_id, hiring_score, TIMESTAMP '{AS_OF}' AS last_checked FROM {{companies}}")
def touch_companies(d):
    return M.touch_companies(d.view("companies"), AS_OF).select("company_id", "hiring_score", "last_checked")


@check("validation_batch", """
SELECT job_id, status, job_url FROM {jobs} WHERE status = 'unknown' OR (status = 'open' AND last_checked IS NULL)
ORDER BY job_id LIMIT 100
""")
def validation_batch(d):
    return M.validation_batch(d.view("jobs"), 100).select("job_id", "status", "job_url")


# A verdict for most jobs; null stands for a page without text.
VERDICTS = """
SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'open' WHEN 2 THEN 'unknown' ELSE 'closed' END AS status,
       CASE o_orderkey % 2 WHEN 0 THEN 'keyword_fallback' ELSE 'ai_ollama' END AS method,
       CASE o_orderkey % 2 WHEN 0 THEN 'Found 1 open indicators' END AS reason
FROM {orders} WHERE o_totalprice > 10000"""


@check("apply_validation", f"""
SELECT job_id, coalesce(v.status, j.status) AS status,
       CASE WHEN v.status IS NULL THEN last_checked ELSE TIMESTAMP '{AS_OF}' END AS last_checked
FROM {{jobs}} j LEFT JOIN ({VERDICTS}) v USING (job_id)
""")
def apply_validation(d):
    return M.apply_validation(d.view("jobs"), d.sql(VERDICTS), AS_OF).select("job_id", "status", "last_checked")


@check("status_changes", f"""
SELECT job_id, j.status AS old_status, v.status AS new_status, concat(method, ': ', coalesce(reason, 'AI classification')) AS change_reason,
       TIMESTAMP '{AS_OF}' AS changed_at
FROM {{jobs}} j JOIN ({VERDICTS}) v USING (job_id) WHERE v.status <> j.status
""")
def status_changes(d):
    return M.status_changes(d.view("jobs"), d.sql(VERDICTS), AS_OF)


# Requests: some for companies that do not exist, many for URLs that are taken or asked for twice.
REQUESTS = """
SELECT l_orderkey * 10 + l_linenumber AS seq, max(CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey + 1000000000 ELSE l_suppkey END) AS company_id,
       max(concat('https://new.example.com/jobs/', l_partkey, '-', l_linenumber)) AS job_url, min(l_suppkey) AS supplier
FROM {lineitem} GROUP BY l_orderkey * 10 + l_linenumber"""
TAKEN = "SELECT concat('https://new.example.com/jobs/', p_partkey, '-1') AS job_url FROM {part}"
DECIDED = f"""
requests AS ({REQUESTS}), taken AS ({TAKEN}),
known AS (SELECT r.*, c.company_id IS NOT NULL AS parent, t.job_url IS NOT NULL AS used FROM requests r
  LEFT JOIN {{companies}} c USING (company_id) LEFT JOIN (SELECT DISTINCT job_url FROM taken) t USING (job_url)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_url, parent ORDER BY seq) AS rn FROM known)
"""


@check("insert_checked", f"""
WITH {DECIDED}
SELECT seq, company_id, job_url, CASE WHEN NOT parent THEN 404 WHEN used OR rn > 1 THEN 400 ELSE 201 END AS code FROM ranked
""")
def insert_checked(d):
    out = M.insert_checked("jobs", d.sql(REQUESTS), d.sql(TAKEN), d.view("companies"))
    accepted = out.accepted.select("seq", "company_id", "job_url", F.lit(201).alias("code"))
    return accepted.unionByName(out.rejected.select("seq", "company_id", "job_url", "code"))


@check("insert_checked_companies", """
WITH requests AS (SELECT s_suppkey AS seq, concat('https://c', s_nationkey * 50, '.example.com/careers') AS career_page_url FROM {supplier}),
ranked AS (SELECT r.*, c.company_id IS NOT NULL AS used, row_number() OVER (PARTITION BY career_page_url ORDER BY seq) AS rn
           FROM requests r LEFT JOIN {companies} c USING (career_page_url))
SELECT seq, career_page_url, CASE WHEN used OR rn > 1 THEN 400 ELSE 201 END AS code FROM ranked
""")
def insert_companies(d):
    asked = d.sql("SELECT s_suppkey AS seq, concat('https://c', s_nationkey * 50, '.example.com/careers') AS career_page_url FROM {supplier}")
    out = M.insert_checked("companies", asked, d.view("companies"))
    accepted = out.accepted.withColumn("code", F.lit(201))
    return accepted.unionByName(out.rejected.drop("reason"))


@check("insert_created", f"""
WITH {DECIDED}
SELECT company_id, job_url, 'unknown' AS status, 'unknown' AS job_type, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM ranked WHERE parent AND NOT used AND rn = 1
""")
def insert_created(d):
    out = M.insert_checked("jobs", d.sql(REQUESTS), d.sql(TAKEN), d.view("companies"))
    rows = M.created_rows("jobs", out.accepted.select("seq", "company_id", "job_url"), AS_OF)
    return rows.select("company_id", "job_url", "status", "job_type", "created_at", "updated_at")


_CONFIG_REQUESTS = """
SELECT s_suppkey AS seq, s_suppkey * 3 AS company_id, concat('li.', s_nationkey) AS job_listing_selector,
       CASE WHEN s_suppkey % 7 = 0 THEN repeat('p', 51) WHEN s_suppkey % 2 = 0 THEN 'next' END AS pagination_type FROM {supplier}"""


@check("insert_site_configs", f"""
SELECT r.seq, r.company_id, CASE WHEN length(pagination_type) > 50 THEN NULL ELSE coalesce(pagination_type, 'none') END AS pagination_type,
       CASE WHEN length(pagination_type) > 50 THEN 422 WHEN c.company_id IS NULL THEN 404 ELSE 201 END AS code
FROM ({_CONFIG_REQUESTS}) r LEFT JOIN {{companies}} c USING (company_id)
""")
def insert_site_configs(d):
    decided = M.decide_inserts("site_configs", d.sql(_CONFIG_REQUESTS), companies=d.view("companies"))
    good = decided.filter("code IS NULL")
    made = M.created_rows("site_configs", good, AS_OF).select("company_id", "pagination_type")
    good = good.select("seq", "company_id").join(made, "company_id").withColumn("code", F.lit(201))
    shown = F.when(F.col("code") == 404, F.coalesce("pagination_type", F.lit("none")))
    return good.unionByName(decided.filter("code IS NOT NULL").select("seq", "company_id", shown.alias("pagination_type"), "code"))


# Several patches per job, in order; a supplied null counts.
PATCHES = """
SELECT l_orderkey AS job_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq, l_linestatus = 'O' AS set_job_title,
       concat('Title ', l_partkey * 100000 + l_suppkey * 10 + l_linenumber) AS job_title, l_returnflag = 'R' AS set_location,
       CASE WHEN l_partkey % 2 = 0 THEN concat('Town ', l_partkey * 100000 + l_suppkey * 10 + l_linenumber) END AS location
FROM {lineitem}"""


@check("patch_rows", f"""
WITH patches AS ({PATCHES}),
titles AS (SELECT job_id, job_title, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM patches WHERE set_job_title),
places AS (SELECT job_id, location, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM patches WHERE set_location)
SELECT j.job_id, CASE WHEN t.job_id IS NULL THEN j.job_title ELSE t.job_title END AS job_title,
       CASE WHEN p.job_id IS NULL THEN j.location ELSE p.location END AS location, j.status,
       CASE WHEN t.job_id IS NOT NULL OR (p.job_id IS NOT NULL AND p.location IS DISTINCT FROM j.location)
            THEN TIMESTAMP '{AS_OF}' ELSE j.last_checked END AS last_checked
FROM {{jobs}} j LEFT JOIN (SELECT * FROM titles WHERE rn = 1) t USING (job_id) LEFT JOIN (SELECT * FROM places WHERE rn = 1) p USING (job_id)
""")
def patch_rows(d):
    out = M.patch_rows(d.view("jobs"), d.sql(PATCHES), "job_id", M.JOB_PATCHABLE, AS_OF)
    return out.select("job_id", "job_title", "location", "status", "last_checked")


_ASKED = """
SELECT l_orderkey * 2 AS job_id, l_linenumber AS seq, l_partkey % 3 = 0 AS set_job_title,
       CASE l_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Cook' ELSE repeat('t', 499 + CAST(l_partkey % 4 AS INT)) END AS job_title,
       l_partkey % 2 = 0 AS set_status, CASE l_suppkey % 5 WHEN 0 THEN 'gone' ELSE 'open' END AS status FROM {lineitem}"""


@check("patch_decisions", f"""
SELECT a.job_id, seq, CASE WHEN set_job_title AND (job_title = '' OR length(job_title) > 500) THEN 422 WHEN set_status AND status = 'gone' THEN 422
                           WHEN j.job_id IS NULL THEN 404 END AS code
FROM ({_ASKED}) a LEFT JOIN (SELECT job_id FROM {{jobs}}) j USING (job_id)
""")
def patch_decisions(d):
    return M.decide_patches("jobs", d.view("jobs"), d.sql(_ASKED), "job_id").select("job_id", "seq", "code")


@check("delete_cascade", """
WITH gone AS (SELECT c_custkey AS company_id FROM {customer} WHERE c_mktsegment = 'FURNITURE'),
left_jobs AS (SELECT * FROM {jobs} WHERE company_id NOT IN (SELECT company_id FROM gone)
              AND job_id NOT IN (SELECT o_orderkey FROM {orders} WHERE o_totalprice < 50000)),
gone_jobs AS (SELECT job_id FROM {jobs} WHERE company_id IN (SELECT company_id FROM gone)
              UNION SELECT o_orderkey FROM {orders} WHERE o_totalprice < 50000)
SELECT 'companies' AS table_name, count(*) AS n, CAST(sum(company_id) AS BIGINT) AS keys FROM {companies} WHERE company_id NOT IN (SELECT company_id FROM gone)
UNION ALL SELECT 'jobs', count(*), CAST(sum(job_id) AS BIGINT) FROM left_jobs
UNION ALL SELECT 'job_history', count(*), CAST(sum(job_id) AS BIGINT) FROM {job_history} WHERE job_id NOT IN (SELECT job_id FROM gone_jobs)
UNION ALL SELECT 'site_configs', count(*), CAST(sum(config_id) AS BIGINT) FROM {site_configs} WHERE company_id NOT IN (SELECT company_id FROM gone)
""")
def delete_cascade(d):
    gone = d.sql("SELECT c_custkey AS company_id FROM {customer} WHERE c_mktsegment = 'FURNITURE'")
    cheap = d.sql("SELECT o_orderkey AS job_id FROM {orders} WHERE o_totalprice < 50000")
    out = M.delete_cascade(d.tables(), gone, cheap)
    keys = {"companies": "company_id", "jobs": "job_id", "job_history": "job_id", "site_configs": "config_id"}
    rows = [out[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.sum(k).alias("keys")) for t, k in keys.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


# Rows with every kind of fault.
BROKEN_JOBS = KNOWN + """
UNION ALL SELECT l_orderkey + 2000000000, l_suppkey, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN repeat('x', 501) ELSE 'ok' END,
  CASE l_linenumber WHEN 3 THEN NULL ELSE concat('u', l_partkey) END, CASE l_linenumber WHEN 4 THEN repeat('y', 256) END,
  CASE l_linenumber WHEN 5 THEN 'office' ELSE 'onsite' END, CASE l_linenumber WHEN 6 THEN 'gone' ELSE 'open' END, NULL, l_shipdate
FROM {lineitem}"""


@check("quality_report", f"""
WITH j AS ({BROKEN_JOBS})
SELECT 'companies.company_name required' AS rule, count(*) FILTER (coalesce(company_name, '') = '') AS violations FROM {{companies}}
UNION ALL SELECT 'companies.career_page_url required', count(*) FILTER (coalesce(career_page_url, '') = '') FROM {{companies}}
UNION ALL SELECT 'companies.company_name length', count(*) FILTER (length(company_name) > 255) FROM {{companies}}
UNION ALL SELECT 'companies.industry length', count(*) FILTER (length(industry) > 100) FROM {{companies}}
UNION ALL SELECT 'jobs.job_title required', count(*) FILTER (coalesce(job_title, '') = '') FROM j
UNION ALL SELECT 'jobs.job_url required', count(*) FILTER (coalesce(job_url, '') = '') FROM j
UNION ALL SELECT 'jobs.job_title length', count(*) FILTER (length(job_title) > 500) FROM j
UNION ALL SELECT 'jobs.location length', count(*) FILTER (length(location) > 255) FROM j
UNION ALL SELECT 'jobs.status allowed', count(*) FILTER (coalesce(status, '') NOT IN ('open', 'closed', 'unknown')) FROM j
UNION ALL SELECT 'jobs.job_type allowed', count(*) FILTER (coalesce(job_type, '') NOT IN ('remote', 'hybrid', 'onsite', 'unknown')) FROM j
UNION ALL SELECT 'job_history.old_status allowed', count(*) FILTER (old_status NOT IN ('open', 'closed', 'unknown')) FROM {{job_history}}
UNION ALL SELECT 'job_history.new_status allowed', count(*) FILTER (coalesce(new_status, '') NOT IN ('open', 'closed', 'unknown')) FROM {{job_history}}
UNION ALL SELECT 'site_configs.pagination_type length', 0
UNION ALL SELECT 'companies.company_id unique', count(*) - count(DISTINCT company_id) FROM {{companies}}
UNION ALL SELECT 'jobs.job_id unique', count(*) FROM (SELECT job_id FROM j GROUP BY job_id HAVING count(*) > 1)
UNION ALL SELECT 'jobs.company_id+job_url unique', count(*) FROM (SELECT company_id, job_url FROM j GROUP BY company_id, job_url HAVING count(*) > 1)
UNION ALL SELECT 'site_configs.one active per company', count(*) FROM (SELECT company_id FROM {{site_configs}} WHERE is_active GROUP BY company_id HAVING count(*) > 1)
UNION ALL SELECT 'site_configs.selectors usable', count(*) FROM {{site_configs}} WHERE is_active AND company_id % 9 = 4 AND config_id < 1000000000
UNION ALL SELECT 'jobs.company_id known', count(*) FROM j WHERE company_id NOT IN (SELECT company_id FROM {{companies}})
UNION ALL SELECT 'job_history.job_id known', count(*) FROM {{job_history}} WHERE job_id NOT IN (SELECT job_id FROM j)
UNION ALL SELECT 'site_configs.company_id known', count(*) FROM {{site_configs}} WHERE company_id NOT IN (SELECT company_id FROM {{companies}})
""")
def quality_report(d):
    # not conformed: that would turn missing values into defaults
    tables = d.tables()
    # some selectors that the page scan has no way to follow
    faulty = F.when(F.expr("company_id % 9 = 4 AND config_id < 1000000000"), "time:hover").otherwise(F.col("job_date_selector"))
    return report({**tables, "jobs": d.sql(BROKEN_JOBS), "site_configs": tables["site_configs"].withColumn("job_date_selector", faulty)})
