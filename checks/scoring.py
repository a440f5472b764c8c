from pyspark.sql import functions as F

from checks.base import AS_OF, CLOSURE_HOURS, UPDATE_HOURS, check
from jobtide.operators import scoring as S
from jobtide.operators.merging import upsert_jobs

_STATS = """
SELECT company_id, count(*) AS total_jobs, count(*) FILTER (status = 'open') AS open_jobs,
       count(*) FILTER (status = 'closed') AS closed_jobs FROM {jobs} GROUP BY company_id"""
_UPDATES = f"""
SELECT company_id, count(*) AS job_updates FROM {{job_history}} h JOIN {{jobs}} j USING (job_id)
WHERE h.changed_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{UPDATE_HOURS}' HOUR AND h.old_status <> h.new_status
GROUP BY company_id"""
_CLOSURES = f"""
SELECT company_id, count(*) AS closed_jobs_delta FROM {{job_history}} h JOIN {{jobs}} j USING (job_id)
WHERE h.changed_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{CLOSURE_HOURS}' HOUR AND h.new_status = 'closed'
  AND j.status = 'closed' GROUP BY company_id"""
SIGNALS = f"""
facts AS (
  SELECT c.company_id, c.company_name, c.last_job_count, CAST(c.hiring_score AS BIGINT) AS previous_score,
         coalesce(total_jobs, 0) AS total_jobs, coalesce(open_jobs, 0) AS open_jobs,
         coalesce(closed_jobs, 0) AS closed_jobs, coalesce(job_updates, 0) AS job_updates,
         coalesce(closed_jobs_delta, 0) AS closed_jobs_delta
  FROM {{companies}} c LEFT JOIN ({_STATS}) s USING (company_id) LEFT JOIN ({_UPDATES}) u USING (company_id)
  LEFT JOIN ({_CLOSURES}) k USING (company_id)),
gains AS (SELECT *, greatest(0, total_jobs - last_job_count) AS new_jobs FROM facts),
deltas AS (SELECT *, CAST(5 * new_jobs + CASE WHEN new_jobs >= 3 THEN 10 ELSE 0 END
                   - 5 * closed_jobs_delta + 3 * job_updates AS BIGINT) AS score_change FROM gains),
signals AS (SELECT company_id, company_name, previous_score, greatest(0, previous_score + score_change) AS new_score,
                   score_change, total_jobs, open_jobs, closed_jobs, new_jobs, closed_jobs_delta, job_updates FROM deltas)
"""


def signals_of(d):
    return S.company_signals(d.view("companies"), d.view("jobs"), d.view("job_history"), AS_OF, UPDATE_HOURS, CLOSURE_HOURS)


@check("job_stats", f"""
SELECT c.company_id, coalesce(total_jobs, 0) AS total_jobs, coalesce(open_jobs, 0) AS open_jobs,
       coalesce(closed_jobs, 0) AS closed_jobs FROM {{companies}} c LEFT JOIN ({_STATS}) s USING (company_id)
""")
def job_stats(d):
    return S.job_stats(d.view("companies"), d.view("jobs"))


@check("recent_updates", _UPDATES)
def recent_updates(d):
    return S.recent_updates(d.view("jobs"), d.view("job_history"), AS_OF, UPDATE_HOURS)


@check("recent_closures", _CLOSURES)
def recent_closures(d):
    return S.recent_closures(d.view("jobs"), d.view("job_history"), AS_OF, CLOSURE_HOURS)


@check("score_delta", """
WITH facts AS (SELECT o_orderkey AS id, CAST(o_custkey % 9 AS INT) AS last_job_count, o_orderkey % 17 AS total_jobs,
  o_custkey % 5 AS closed_jobs_delta, o_orderkey % 3 AS job_updates, o_custkey % 40 AS previous_score FROM {orders}),
deltas AS (SELECT id, previous_score, greatest(0, total_jobs - last_job_count) AS new_jobs,
  5 * greatest(0, total_jobs - last_job_count) + CASE WHEN total_jobs - last_job_count >= 3 THEN 10 ELSE 0 END
  - 5 * closed_jobs_delta + 3 * job_updates AS score_change FROM facts)
SELECT id, new_jobs, score_change, greatest(0, previous_score + score_change) AS new_score FROM deltas
""")
def score_delta(d):
    facts = d.sql("""SELECT o_orderkey AS id, CAST(o_custkey % 9 AS INT) AS last_job_count, o_orderkey % 17 AS total_jobs,
      o_custkey % 5 AS closed_jobs_delta, o_orderkey % 3 AS job_updates, o_custkey % 40 AS previous_score FROM {orders}""")
    return S.score_delta(facts).select("id", "new_jobs", "score_change", "new_score")


@check("company_signals", f"WITH {SIGNALS} SELECT * FROM signals")
def company_signals(d):
    return signals_of(d)


@check("apply_signals", f"""
WITH {SIGNALS} SELECT c.company_id, CAST(total_jobs AS INT) AS current_job_count, CAST(total_jobs AS INT) AS last_job_count,
  CAST(new_score AS INT) AS hiring_score, TIMESTAMP '{AS_OF}' AS last_checked
FROM {{companies}} c JOIN signals USING (company_id)
""")
def apply_signals(d):
    out = S.apply_signals(d.view("companies"), signals_of(d), AS_OF, advance_baseline=True)
    return out.select("company_id", "current_job_count", "last_job_count", "hiring_score", "last_checked")


@check("top_companies", """
SELECT company_id, company_name, hiring_score FROM {companies} WHERE hiring_score >= 20
ORDER BY hiring_score DESC, company_id LIMIT 10
""")
def top_companies(d):
    return S.top_companies(d.view("companies"), 10, 20).select("company_id", "company_name", "hiring_score")


@check("run_report", f"""
WITH {SIGNALS},
known AS (SELECT job_url, count(*) AS holders FROM {{jobs}} GROUP BY job_url)
SELECT 'crawl' AS task, 'companies_processed' AS metric, count(*) AS value FROM {{companies}}
UNION ALL SELECT 'crawl', 'jobs_added', count(DISTINCT job_url) FROM {{listings}} WHERE job_url <> ''
UNION ALL SELECT 'validation', 'jobs_validated', count(*) FROM {{jobs}}
UNION ALL SELECT 'validation', 'jobs_closed', count(*) FROM {{jobs}} WHERE status = 'closed'
UNION ALL SELECT 'scoring', 'companies_updated', count(*) FROM signals
UNION ALL SELECT 'validation', 'errors', count(*) FROM {{observations}} WHERE status IS NULL
""")
def run_report(d):
    listings = d.view("listings").withColumns({"date_posted": F.lit(None).cast("timestamp"), "description_preview": F.lit(None).cast("string")})
    failed = d.view("observations").filter("status is null")
    errors = failed.select(F.lit("validation").alias("task"), F.col("job_id").cast("string").alias("item"), F.lit("no answer").alias("error"))
    inserted = upsert_jobs(d.view("jobs"), listings, AS_OF).inserted
    return S.run_report(d.view("companies"), inserted, d.view("jobs"), signals_of(d), errors)


@check("score_timeline", """
WITH created AS (
  SELECT company_id, CASE WHEN created_at = date_trunc('day', created_at) THEN created_at
         ELSE date_trunc('day', created_at) + INTERVAL '1' DAY END AS run_at, count(*) AS new_jobs, 0 AS updates, 0 AS closures
  FROM {jobs} GROUP BY 1, 2),
moved AS (SELECT company_id, j.status, h.old_status, h.new_status, h.changed_at FROM {job_history} h JOIN {jobs} j USING (job_id)),
spread AS (
  SELECT company_id, date_trunc('day', changed_at + INTERVAL '23:59:59.999999') + INTERVAL '1' DAY * age AS run_at,
         changed_at, status, old_status, new_status FROM moved, (SELECT unnest(range(4)) AS age)),
changed AS (
  SELECT company_id, run_at, 0 AS new_jobs,
         count(*) FILTER (old_status <> new_status AND run_at <= changed_at + INTERVAL '24' HOUR) AS updates,
         count(*) FILTER (new_status = 'closed' AND status = 'closed' AND run_at <= changed_at + INTERVAL '48' HOUR) AS closures
  FROM spread GROUP BY 1, 2),
runs AS (
  SELECT company_id, run_at, CAST(sum(new_jobs) AS BIGINT) AS n, CAST(sum(closures) AS BIGINT) AS k, CAST(sum(updates) AS BIGINT) AS u
  FROM (SELECT * FROM created UNION ALL SELECT * FROM changed) GROUP BY 1, 2),
deltas AS (
  SELECT company_id, run_at, CAST(5 * n + CASE WHEN n >= 3 THEN 10 ELSE 0 END - 5 * k + 3 * u AS BIGINT) AS delta FROM runs),
sums AS (
  SELECT d.*, c.hiring_score + sum(delta) OVER (PARTITION BY company_id ORDER BY run_at) AS p
  FROM deltas d JOIN {companies} c USING (company_id) WHERE delta <> 0)
SELECT company_id, run_at, delta, CAST(p - least(0, min(p) OVER (PARTITION BY company_id ORDER BY run_at)) AS BIGINT) AS score
FROM sums
""")
def score_timeline(d):
    deltas = S.run_deltas(d.view("jobs"), d.view("job_history"), every_hours=24)
    return S.score_timeline(deltas, d.view("companies"), block="year")
