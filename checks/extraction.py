from pyspark.sql import functions as F

from checks.base import AS_OF, check
from jobtide.functions.dates import parse_posted
from jobtide.functions.text import clean_text
from jobtide.functions.urls import resolve_url
from jobtide.operators import extraction as X
from jobtide.plans.runs import crawl_run
from jobtide.schemas import conform
from jobtide.sources.tables import spread

# every nav anchor of a page with its position
ANCHORS = r"""
anchors AS (
  SELECT company_id, page_num, page_id, url, i AS element_pos, hrefs[i + 1] AS href, labels[i + 1] AS label
  FROM (SELECT *, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels FROM {crawled_pages}),
       unnest(range(len(hrefs))) AS t(i))
"""


def companies_of(d):
    """One company per group of crawled pages."""
    address = F.concat(F.lit("https://c"), "company_id", F.lit(".example.com/careers")).alias("career_page_url")
    return d.view("crawled_pages").select("company_id").distinct().select("company_id", address)


def elements(d, html=None, listing="nav li"):
    """Elements of all crawled pages, every company having one listing selector of its own."""
    pages = d.view("crawled_pages")
    if html is not None:
        pages = pages.withColumn("html", html)
    own = {name: F.lit(None).cast("string") for name in X._SELECTORS} | {"job_listing_selector": F.lit(listing)}
    configs = companies_of(d).withColumns({"config_id": F.col("company_id"), "is_active": F.lit(True), **own})
    return X.listing_elements(X.with_selectors(pages, configs))


@check("site_config_resolve", """
WITH chosen AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY config_id) AS rn FROM {site_configs} WHERE is_active)
SELECT c.company_id,
  coalesce(nullif(job_listing_selector, ''), '[data-job-id], [class*=''job-card''], [class*=''job-listing''], [class*=''job posting''], article.job, div[data-id*=''job''], li.job-item, .job, a[href*=''/jobs/'']') AS job_listing_selector,
  coalesce(nullif(job_title_selector, ''), '[data-testid=''job-title''], h2, h3, a.job-link') AS job_title_selector,
  coalesce(nullif(job_url_selector, ''), 'a[href*=''job''], a[href*=''career''], a') AS job_url_selector,
  coalesce(nullif(job_location_selector, ''), '[class*=''location''], [class*=''city''], [class*=''remote'']') AS job_location_selector,
  coalesce(nullif(job_date_selector, ''), '[class*=''date''], [class*=''posted''], time') AS job_date_selector
FROM {companies} c LEFT JOIN (SELECT * FROM chosen WHERE rn = 1) s USING (company_id)
""")
def site_config_resolve(d):
    out = X.resolve_config(d.view("companies"), d.view("site_configs"))
    return out.select("company_id", *X._SELECTORS)


@check("listing_elements", f"""
WITH {ANCHORS} SELECT company_id, page_num, CAST(element_pos AS INT) AS element_pos, 'selector' AS source, href, label AS self_text FROM anchors
""")
def listing_elements(d):
    return elements(d).select("company_id", "page_num", "element_pos", "source", "href", "self_text")


@check("job_link_fallback", f"""
WITH {ANCHORS} SELECT company_id, page_num, CAST(element_pos AS INT) AS element_pos, concat('/career', href) AS href, label AS self_text
FROM anchors WHERE url LIKE '%/en/%'
""")
def job_link_fallback(d):
    linked = F.when(F.col("url").contains("/en/"), F.replace("html", F.lit('<a href="/'), F.lit('<a href="/career/'))).otherwise(F.col("html"))
    found = X.job_link_fallback(elements(d, linked, ".no-such-listing"))
    return found.select("company_id", "page_num", "element_pos", "href", "self_text")


_JSONLD = """
SELECT page_id, company_id, page_num, html, CASE page_id % 6
  WHEN 0 THEN concat('{"@type": "JobPosting", "title": "Role ', page_id, '", "url": "https://x.example.com/', page_id,
    '", "datePosted": "2024-01-15T10:30:00Z", "description": "', repeat('long text ', 60),
    '", "jobLocation": {"address": {"addressLocality": "Oslo"}}}')
  WHEN 1 THEN concat('[{"@type": "JobPosting", "title": "First ', page_id, '", "identifier": {"value": "id-', page_id,
    '"}, "datePosted": "2024-02-29"}, {"@type": "Other"}]')
  WHEN 2 THEN concat('[{"@type": "Other", "title": "Item ', page_id, '", "url": "u", "datePosted": "soon"}, {"@type": "JobPosting"}]')
  WHEN 3 THEN '{"@type": "JobPosting", "title": '
  WHEN 4 THEN '{"@type": "Organization", "title": "no job", "url": "u"}'
  ELSE '{"@type": "JobPosting", "title": "No link", "datePosted": 20240101}' END AS block
FROM {crawled_pages}"""


@check("jsonld_jobs", """
SELECT company_id, page_num,
  CASE page_id % 6 WHEN 0 THEN concat('Role ', page_id) WHEN 1 THEN concat('First ', page_id)
    WHEN 2 THEN concat('Item ', page_id) ELSE 'No link' END AS job_title,
  CASE page_id % 6 WHEN 0 THEN concat('https://x.example.com/', page_id) WHEN 1 THEN concat('id-', page_id)
    WHEN 2 THEN 'u' ELSE '' END AS job_url,
  CASE page_id % 6 WHEN 0 THEN 'Oslo' ELSE '' END AS location,
  CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-01-15 10:30:00' WHEN 1 THEN TIMESTAMP '2024-02-29 00:00:00' END AS date_posted,
  CASE page_id % 6 WHEN 0 THEN substr(repeat('long text ', 60), 1, 500) END AS description_preview
FROM {crawled_pages} WHERE page_id % 6 NOT IN (3, 4)
""")
def jsonld_jobs(d):
    pages = d.sql(_JSONLD).withColumn(
        "html", F.concat("html", F.lit('<script type="application/ld+json">'), "block", F.lit("</script>"))
    )
    none_active = d.view("site_configs").filter("config_id < 0")
    found = X.listing_elements(X.with_selectors(pages, none_active))
    return X.jsonld_jobs(found).drop("raw_data", "element_pos")


_CARD = """concat('<li><h3>  Role
   ', page_id, ' </h3><span class="job-location">City ', page_id % 7, '</span>',
  CASE page_id % 3 WHEN 0 THEN '<time datetime="2024-01-15T10:00:00+01:00">x</time>'
    WHEN 1 THEN concat('<b class="posted">Posted ', page_id % 20, ' days ago</b>') ELSE '' END,
  '<p class="summary">About ', url, '</p><a ')"""


@check("listing_fields", f"""
WITH {ANCHORS}
SELECT company_id, page_num, CAST(element_pos AS INT) AS element_pos, concat('Role ', page_id) AS job_title,
  concat('https://c', company_id, '.example.com', href) AS job_url, concat('City ', page_id % 7) AS location,
  CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 09:00:00'
    WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY * (page_id % 20) END AS date_posted,
  substr(concat('About ', url), 1, 500) AS description_preview
FROM anchors
""")
def listing_fields(d):
    cards = F.replace(F.col("html"), F.lit("<li><a "), F.expr(_CARD))
    return X.listing_fields(X.with_base(elements(d, cards), companies_of(d)), AS_OF).drop("raw_data")


_SPACED = "concat('  \t', replace(text, ' ', '   '), '\n　')"


@check("clean_text", f"""
SELECT doc_id, length(cleaned) AS n_chars, md5(cleaned) AS digest FROM (
  SELECT doc_id, trim(regexp_replace({_SPACED}, '[\\t-\\r \\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS cleaned
  FROM {{documents}})
""")
def cleaned(d):
    texts = d.table("documents").withColumn("cleaned", clean_text(F.expr(_SPACED)))
    return texts.select("doc_id", F.length("cleaned").cast("bigint").alias("n_chars"), F.md5("cleaned").alias("digest"))


_LINKS = """
SELECT l_orderkey, concat('https://c', l_suppkey, '.example.com/a/b/careers?x=1#top') AS base,
  CASE l_linenumber WHEN 1 THEN concat('jobs/', l_partkey) WHEN 2 THEN concat('/jobs/', l_partkey)
    WHEN 3 THEN concat('../jobs/./', l_partkey, '/') WHEN 4 THEN concat('?id=', l_partkey)
    WHEN 5 THEN concat('#job-', l_partkey) WHEN 6 THEN concat('//jobs.example.org/', l_partkey)
    ELSE concat('http://other.example.net/', l_partkey, '/../x') END AS href, l_suppkey, l_partkey, l_linenumber
FROM {lineitem}"""


@check("resolve_url", f"""
SELECT l_orderkey, href, CASE l_linenumber
  WHEN 1 THEN concat('https://c', l_suppkey, '.example.com/a/b/jobs/', l_partkey)
  WHEN 2 THEN concat('https://c', l_suppkey, '.example.com/jobs/', l_partkey)
  WHEN 3 THEN concat('https://c', l_suppkey, '.example.com/a/jobs/', l_partkey, '/')
  WHEN 4 THEN concat('https://c', l_suppkey, '.example.com/a/b/careers?id=', l_partkey)
  WHEN 5 THEN concat('https://c', l_suppkey, '.example.com/a/b/careers?x=1#job-', l_partkey)
  WHEN 6 THEN concat('https://jobs.example.org/', l_partkey) ELSE href END AS job_url
FROM ({_LINKS})
""")
def resolved(d):
    return spread(d.sql(_LINKS)).select("l_orderkey", "href", resolve_url("href", "base").alias("job_url"))


_DATED = """
SELECT o_orderkey, o_custkey,
  CASE o_orderkey % 9 WHEN 0 THEN concat('2024-0', o_custkey % 9 + 1, '-15T08:30:00Z') WHEN 1 THEN concat('2023-1', o_custkey % 3, '-09')
    WHEN 2 THEN 'not a date' END AS attribute,
  CASE o_orderkey % 9 WHEN 2 THEN concat('Posted ', o_custkey % 30, ' days ago') WHEN 3 THEN concat(o_custkey % 50, ' hours ago, 3 weeks ago')
    WHEN 4 THEN concat('about ', o_custkey % 9, ' Weeks  ago') WHEN 5 THEN concat(o_custkey % 7, ' months ago')
    WHEN 6 THEN concat('Posted Jan ', o_custkey % 28 + 1) WHEN 7 THEN concat('POSTED ', o_custkey % 12 + 1, '/9/2022')
    ELSE 'recently' END AS words
FROM {orders}"""


@check("parse_posted_date", f"""
SELECT o_orderkey, CASE o_orderkey % 9
  WHEN 0 THEN make_timestamp(2024, o_custkey % 9 + 1, 15, 8, 30, 0) WHEN 1 THEN make_timestamp(2023, 10 + o_custkey % 3, 9, 0, 0, 0)
  WHEN 2 THEN TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY * (o_custkey % 30)
  WHEN 3 THEN TIMESTAMP '{AS_OF}' - INTERVAL '1' HOUR * (o_custkey % 50)
  WHEN 4 THEN TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY * (o_custkey % 9)
  WHEN 5 THEN TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY * (o_custkey % 7)
  WHEN 6 THEN make_timestamp(2001, 1, o_custkey % 28 + 1, 0, 0, 0)
  WHEN 7 THEN make_timestamp(2022, o_custkey % 12 + 1, 9, 0, 0, 0) END AS date_posted
FROM {{orders}}
""")
def posted(d):
    return spread(d.sql(_DATED)).select("o_orderkey", parse_posted("attribute", "words", AS_OF).alias("date_posted"))


@check("valid_listings", """
SELECT company_id, page_num, element_pos, job_title, job_url, location FROM {listings} WHERE job_title <> '' AND job_url <> ''
""")
def valid_listings(d):
    return X.valid_listings(d.view("listings"))


@check("dedupe_listings", """
SELECT company_id, page_num, element_pos, job_title, job_url, location FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, job_url ORDER BY page_num, element_pos) AS rn FROM {listings})
WHERE rn = 1
""")
def dedupe_listings(d):
    return X.dedupe_listings(d.view("listings"))


@check("job_rows", """
SELECT company_id, job_title, job_url, location, 'unknown' AS status FROM {listings}
""")
def job_rows(d):
    nothing = {"date_posted": F.lit(None).cast("timestamp"), "description_preview": F.lit(None).cast("string")}
    return X.job_rows(d.view("listings").withColumns(nothing)).drop(*nothing)


@check("page_text", r"""
WITH bodies AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM {pages}),
spaced AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '(?s)<aside.*?</aside>', ' ', 'g'), '<(br|/?(p|h1|h2|h3|ul|li|div|table|tr))[^>]*>', ' ', 'g') AS body FROM bodies),
bare AS (SELECT page_id, url, regexp_replace(body, '<[^>]*>', '', 'g') AS body FROM spaced),
plain AS (SELECT page_id, url, trim(regexp_replace(replace(replace(body, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM bare)
SELECT page_id, url, length(body) AS n_chars, md5(body) AS digest FROM plain
""")
def page_text(d):
    texts = X.page_text(d.table("pages")).withColumn("text", clean_text("text"))
    return texts.select("page_id", "url", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


# a crawl in which pages are lost, answer with errors or come without html
_FETCHED = """
SELECT company_id, page_num, page_id, url, CASE WHEN page_id % 17 = 4 THEN NULL ELSE html END AS html,
  CAST(CASE page_id % 11 WHEN 0 THEN 404 WHEN 5 THEN 500 ELSE 200 END AS INT) AS http_status
FROM {crawled_pages} WHERE page_id % 13 <> 3"""


@check("crawl_report", f"""
WITH {ANCHORS},
fetched AS ({_FETCHED} AND page_num <= 3),
companies AS (SELECT DISTINCT company_id FROM {{crawled_pages}} UNION ALL SELECT -1),
last AS (SELECT company_id, max(page_num) AS n FROM fetched GROUP BY 1),
failed AS (
  SELECT DISTINCT company_id, concat('code ', http_status) AS error FROM fetched WHERE http_status >= 400
  UNION ALL SELECT DISTINCT company_id, 'no html' FROM fetched WHERE http_status < 400 AND html IS NULL
  UNION ALL SELECT company_id, concat('no page ', i) FROM last, (SELECT unnest(range(1, 4)) AS i)
            WHERE i < n AND NOT EXISTS (SELECT 1 FROM fetched f WHERE f.company_id = last.company_id AND f.page_num = i)
  UNION ALL SELECT company_id, 'nothing' FROM companies WHERE company_id NOT IN (SELECT company_id FROM fetched))
SELECT 'crawl' AS task, 'companies_processed' AS metric, count(*) AS value FROM companies WHERE company_id NOT IN (SELECT company_id FROM failed)
UNION ALL SELECT 'crawl', 'jobs_added', count(*) FROM (
  SELECT DISTINCT a.company_id, a.href FROM anchors a JOIN fetched f ON a.page_id = f.page_id WHERE f.http_status < 400 AND f.html IS NOT NULL)
UNION ALL SELECT 'crawl', 'errors', count(*) FROM failed HAVING count(*) > 0
""")
def crawl_report(d):
    lost = d.spark.sql("SELECT -1L AS company_id, 'https://lost.example.com/' AS career_page_url")
    companies = companies_of(d).unionByName(lost)
    own = {name: F.lit("nav li" if name == "job_listing_selector" else None).cast("string") for name in X._SELECTORS}
    configs = companies.withColumns({"config_id": F.col("company_id"), "is_active": F.lit(True), **own})
    tables = {"companies": conform(companies, "companies"), "site_configs": conform(configs, "site_configs"), "jobs": d.view("jobs").limit(0), "job_history": d.view("job_history")}
    return crawl_run(tables, d.sql(_FETCHED), AS_OF).report
