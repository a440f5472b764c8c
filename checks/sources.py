from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.base import check
from jobtide.sources.tables import crawled_pages, load_tables, read_snapshot, write_snapshot


@check("tables_load", """
SELECT 'jobs' AS table_name, job_id AS id, company_id AS other, concat_ws('|', job_title, job_url, location, job_type, status) AS texts, created_at AS at FROM {jobs}
UNION ALL SELECT 'companies', company_id, last_job_count, concat_ws('|', company_name, career_page_url, industry), NULL FROM {companies}
UNION ALL SELECT 'job_history', job_id, NULL, concat_ws('|', old_status, new_status), changed_at FROM {job_history}
UNION ALL SELECT 'site_configs', config_id, company_id,
                 concat_ws('|', job_listing_selector, job_title_selector, job_location_selector, CASE WHEN is_active THEN 'on' ELSE 'off' END), NULL FROM {site_configs}
""")
def tables_load(d):
    root = d.folder_for("tables")
    tables = d.tables()
    # the stored jobs lack columns, call their key otherwise and spell statuses in capitals, the default one as null
    status = F.nullif(F.upper("status"), F.lit("UNKNOWN"))
    stored = tables["jobs"].drop("description_preview", "updated_at").withColumn("status", status).withColumnRenamed("job_id", "id")
    for name, df in {**tables, "jobs": stored}.items():
        df.write.parquet(f"{root}/{name}")
    names = {"OPEN": "open", "CLOSED": "closed"}
    loaded = load_tables(d.spark, root, columns={"jobs": {"id": "job_id"}}, values={"jobs": {"status": names}})
    active = F.when(F.col("is_active"), "on").otherwise("off")
    parts = {
        "jobs": ("job_id", "company_id", ["job_title", "job_url", "location", "job_type", "status"], "created_at"),
        "companies": ("company_id", "last_job_count", ["company_name", "career_page_url", "industry"], None),
        "job_history": ("job_id", None, ["old_status", "new_status"], "changed_at"),
        "site_configs": ("config_id", "company_id", ["job_listing_selector", "job_title_selector", "job_location_selector", active], None),
    }
    rows = [
        loaded[name].select(
            F.lit(name).alias("table_name"),
            F.col(key).alias("id"),
            (F.col(other) if other else F.lit(None)).cast("bigint").alias("other"),
            F.concat_ws("|", *texts).alias("texts"),
            (F.col(at) if at else F.lit(None)).cast("timestamp").alias("at"),
        )
        for name, (key, other, texts, at) in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@check("pages_source", """
SELECT company_id, page_num, url, length(html) AS html_chars FROM {crawled_pages} WHERE page_num <= 3
""")
def pages_source(d):
    pages = crawled_pages(d.view("crawled_pages"), max_pages=3)
    return pages.select("company_id", "page_num", "url", F.length("html").cast("bigint").alias("html_chars"))


@check("snapshot_write", """
SELECT 'companies' AS table_name, count(*) AS n, CAST(sum(company_id) AS BIGINT) AS keys FROM {companies}
UNION ALL SELECT 'jobs', count(*), CAST(sum(job_id) AS BIGINT) FROM {jobs}
UNION ALL SELECT 'job_history', count(*), CAST(sum(job_id) AS BIGINT) FROM {job_history}
UNION ALL SELECT 'site_configs', count(*), CAST(sum(config_id) AS BIGINT) FROM {site_configs}
""")
def snapshot_write(d):
    # the second run changes companies only and adds half of the history to what the first one wrote
    root, tables = d.folder_for("snapshot"), d.tables()
    history = tables["job_history"].withColumn("half", F.pmod(F.xxhash64(*tables["job_history"].columns), F.lit(2)))
    first, second = (history.where(F.col("half") == n).drop("half") for n in (0, 1))
    write_snapshot({**tables, "companies": tables["companies"].limit(0), "job_history": first}, root, "run-1")
    write_snapshot({"companies": tables["companies"]}, root, "run-2", added={"job_history": second})
    keys = {"companies": "company_id", "jobs": "job_id", "job_history": "job_id", "site_configs": "config_id"}
    rows = [
        df.agg(F.count("*").alias("n"), F.sum(keys[name]).alias("keys")).select(F.lit(name).alias("table_name"), "n", "keys")
        for name, df in read_snapshot(d.spark, root, "run-2").items()
    ]
    return reduce(DataFrame.unionByName, rows)
