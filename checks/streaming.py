from pyspark.sql import functions as F

from checks.base import AS_OF, CLOSURE_HOURS, check, instants
from checks.extraction import ANCHORS, companies_of
from checks.merging import CRAWL, KNOWN, MERGED, _conformed, _SHOWN
from jobtide.operators.extraction import _SELECTORS
from jobtide.sources.tables import conform_pages, stream_pages
from jobtide.streaming import activity, changes, crawl


def stream_of(d, table):
    """A driver table as a stream of its files. The pattern lets it be one file as well as a folder."""
    path = d.path(table)
    schema = d.spark.read.parquet(path).schema
    return instants(d.spark.readStream.schema(schema).parquet(path.replace(".parquet", ".parque[t]")))


@check("stream_status_changes", """
SELECT job_id, coalesce(before, 'unknown') AS old_status, status AS new_status, observed_at AS changed_at FROM (
  SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY observed_at) AS before FROM {observations} WHERE status IS NOT NULL)
WHERE coalesce(before, 'unknown') <> status
""")
def stream_status_changes(d):
    seen = stream_of(d, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("observed_at"),
        F.when(F.col("event_type") == "signup", "unknown").when(F.col("event_type") == "purchase", "closed")
        .when(F.col("event_type") != "error", "open").alias("status"),
    )
    root = d.folder_for("status-changes")
    changes.status_changes_stream(seen, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return changes.changes_written(d.spark, f"{root}/changes")


@check("status_changes_table", """
SELECT job_id, coalesce(before, 'unknown') AS old_status, status AS new_status, observed_at AS changed_at FROM (
  SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY observed_at) AS before FROM {observations} WHERE status IS NOT NULL)
WHERE coalesce(before, 'unknown') <> status
""")
def status_changes_table(d):
    return changes.status_changes_batch(d.view("observations"))


@check("stream_upsert", f"WITH {MERGED} SELECT {_SHOWN} FROM kept UNION ALL SELECT {_SHOWN} FROM added")
def stream_upsert(d):
    # the crawl arrives as files; jobs are the state before the first of them
    root = d.folder_for("upsert")
    nothing = {"date_posted": F.lit(None).cast("timestamp"), "description_preview": F.lit(None).cast("string")}
    # several triggers; all listings of a URL come in one, as the SQL sees them together
    d.sql(CRAWL).withColumns(nothing).repartition(3, "job_url").write.parquet(f"{root}/crawl")
    files = d.spark.readStream.schema(d.spark.read.parquet(f"{root}/crawl").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/crawl")
    query = crawl.upsert_stream(files, _conformed(d, KNOWN), f"{root}/state", f"{root}/checkpoint", AS_OF, parts=8, files=1)
    query.awaitTermination()
    return crawl.current_jobs(d.spark, f"{root}/state").select(*_SHOWN.split(", "))


@check("stream_activity_windows", f"""
WITH moved AS (SELECT j.company_id, h.changed_at, h.old_status <> h.new_status AS is_update,
                      h.new_status = 'closed' AND j.status = 'closed' AS is_closure
               FROM {{job_history}} h JOIN {{jobs}} j USING (job_id)),
starts AS (SELECT moved.*, time_bucket(INTERVAL '720 hours', changed_at, TIMESTAMP '1970-01-01') - INTERVAL '720 hours' * age AS window_start
           FROM moved, (SELECT unnest(range(2)) AS age))
SELECT company_id, window_start, window_start + INTERVAL '{CLOSURE_HOURS} hours' AS window_end,
       count(*) FILTER (is_update) AS updates, count(*) FILTER (is_closure) AS closures
FROM starts GROUP BY 1, 2
""")
def stream_activity_windows(d):
    history = stream_of(d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_returnflag") == "A", "open").when(F.col("l_returnflag") == "R", "closed").alias("old_status"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("new_status"),
        F.col("l_shipdate").alias("changed_at"),
    )
    root, slide = d.folder_for("activity"), CLOSURE_HOURS // 2
    # the file is in no order of time, so nothing in it may count as late
    activity.activity_stream(history, d.view("jobs"), f"{root}/windows", f"{root}/checkpoint", CLOSURE_HOURS, slide, "3650 days").awaitTermination()
    return activity.activity_windows(d.spark, f"{root}/windows")


@check("stream_first_seen", "SELECT user_id AS company_id, concat('https://c.example.com/jobs/', event_type) AS job_url, min(ts) AS seen_at FROM {events} GROUP BY 1, 2")
def stream_first_seen(d):
    sightings = stream_of(d, "events").select(
        F.col("user_id").alias("company_id"),
        F.concat(F.lit("https://c.example.com/jobs/"), "event_type").alias("job_url"),
        F.col("ts").alias("seen_at"),
    )
    root = d.folder_for("first-seen")
    crawl.first_seen_stream(sightings, f"{root}/seen", f"{root}/checkpoint").awaitTermination()
    return crawl.first_seen(d.spark, f"{root}/seen")


@check("stream_listings", f"""
WITH {ANCHORS},
first AS (SELECT *, row_number() OVER (PARTITION BY company_id, href ORDER BY page_num, element_pos) AS i FROM anchors WHERE page_num <= 3)
SELECT company_id, label AS job_title, concat('https://c', company_id, '.example.com', href) AS job_url, label AS location, 'unknown' AS status
FROM first WHERE i = 1
""")
def stream_listings(d):
    # pages arrive in several files, whose order is not that of the pages
    root, companies = d.folder_for("stream-listings"), companies_of(d)
    pages = conform_pages(d.view("crawled_pages")).repartition(4, F.xxhash64("url"))
    pages.write.option("parquet.block.size", 1 << 20).parquet(f"{root}/pages")
    own = {name: F.lit("nav li" if name == "job_listing_selector" else None).cast("string") for name in _SELECTORS}
    configs = companies.withColumns({"config_id": F.col("company_id"), "is_active": F.lit(True), **own})
    arriving = stream_pages(d.spark, f"{root}/pages", max_pages=3, files_per_trigger=2)
    crawl.listings_stream(arriving, companies, configs, f"{root}/listings", f"{root}/checkpoint", AS_OF).awaitTermination()
    return crawl.listings_found(d.spark, f"{root}/listings").select("company_id", "job_title", "job_url", "location", "status")
