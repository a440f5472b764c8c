"""How the driver's tables stand for the engine's, in SQL that Spark and DuckDB share, and the registry."""

from __future__ import annotations

from functools import cache
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobtide.schemas import TABLES, conform
from jobtide.sources.shared import shared_folder, ship_package
from jobtide.sources.tables import spread

AS_OF = "2001-06-01 00:00:00"
UPDATE_HOURS, CLOSURE_HOURS = 30 * 24, 60 * 24

VIEWS = {
    "companies": """
SELECT c_custkey AS company_id, c_name AS company_name,
       concat('https://c', c_custkey, '.example.com/careers') AS career_page_url,
       c_mktsegment AS industry, CAST(c_custkey % 10 AS INT) AS last_job_count,
       CAST(greatest(0, floor(c_acctbal / 100)) AS INT) AS hiring_score
FROM {customer}""",
    "jobs": """
SELECT o_orderkey AS job_id, o_custkey AS company_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Software Engineer'
            WHEN 2 THEN 'Product Manager' ELSE 'Recruiter' END AS job_title,
       concat('https://c', o_custkey, '.example.com/jobs/', o_orderkey) AS job_url,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE n_name END AS location,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'remote' WHEN '2-HIGH' THEN 'hybrid'
            WHEN '3-MEDIUM' THEN 'onsite' ELSE 'unknown' END AS job_type,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY END AS last_checked,
       o_orderdate AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "job_history": """
SELECT l_orderkey AS job_id,
       CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'R' THEN 'closed' END AS old_status,
       CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'closed' END AS new_status,
       l_shipdate AS changed_at
FROM {lineitem}""",
    # every company but a few has a config; some are switched off, some have empty selectors, some have two
    "site_configs": """
SELECT c_custkey AS config_id, c_custkey AS company_id,
       CASE c_nationkey % 3 WHEN 0 THEN 'li.opening' WHEN 1 THEN '' END AS job_listing_selector,
       concat('h', c_nationkey % 4 + 1) AS job_title_selector, '' AS job_url_selector,
       CASE WHEN c_acctbal > 0 THEN '.place' END AS job_location_selector,
       'time' AS job_date_selector, c_acctbal > -500 AS is_active
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
UNION ALL
SELECT c_custkey + 1000000000, c_custkey, '.second', NULL, NULL, NULL, NULL, TRUE
FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    "observations": """
SELECT user_id AS job_id, ts AS observed_at,
       CASE event_type WHEN 'signup' THEN 'unknown' WHEN 'purchase' THEN 'closed'
            WHEN 'error' THEN NULL ELSE 'open' END AS status
FROM {events}""",
    "posting_texts": """
SELECT doc_id AS posting_id, concat(text, ' ', CASE doc_id % 6
            WHEN 0 THEN 'This position has been filled.'
            WHEN 1 THEN 'Apply now and join our team'
            WHEN 2 THEN 'We are no longer accepting applications; the position is closed'
            WHEN 3 THEN 'job posting expired'
            WHEN 4 THEN 'apply now! submit your application, apply today, apply online, now hiring'
            ELSE '' END) AS text
FROM {documents}""",
    "crawled_pages": """
SELECT CAST(floor(page_id / 4) AS BIGINT) AS company_id, CAST(page_id % 4 + 1 AS INT) AS page_num,
       page_id, url, html FROM {pages}""",
    # raw listings as a crawl of suppliers would give them: many repeats, some without title or link
    "listings": """
SELECT l_suppkey AS company_id, l_linenumber AS page_num, CAST(l_orderkey AS INT) AS element_pos,
       CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat('Role ', l_partkey % 50, ' v', l_orderkey % 3) END AS job_title,
       CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat('https://jobs.example.com/', l_partkey) END AS job_url,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE concat('City ', l_orderkey % 7) END AS location
FROM {lineitem}""",
}
SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

# Tables whose rows are costly to work on.
LONG_TEXTS = ("documents", "pages", "conversations")


class Check(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


CHECKS: dict[str, Check] = {}


class Data:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return spread(df) if name in LONG_TEXTS else df

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL; ``{name}`` stands for a table or view."""
        used = {n: self.table(n) for n in SOURCES if f"{{{n}}}" in text}
        used |= {n: self.view(n) for n in VIEWS if f"{{{n}}}" in text}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            text = text.replace(f"{{{{{name}}}}}", f"{{{name}}}")
        return instants(self.spark.sql(text, **used))

    def view(self, name: str) -> DataFrame:
        df = self.sql(VIEWS[name])
        return conform(df, name) if name in TABLES else df

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.view(name) for name in TABLES}

    def folder_for(self, label: str) -> str:
        return shared_folder(self.spark, label)


def instants(df: DataFrame) -> DataFrame:
    """The files hold times without zone; the engine works with instants."""
    return _recast(df, T.TimestampNTZType(), "timestamp")


def plain(df: DataFrame) -> DataFrame:
    """Results go out without zone again, so that they compare with those of other engines."""
    return _recast(df, T.TimestampType(), "timestamp_ntz")


def _recast(df: DataFrame, kind: T.DataType, to: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(to).alias(f.name) if f.dataType == kind else F.col(f.name) for f in df.schema])


def oracle(body: str) -> str:
    """DuckDB text of a query: views it names become common table expressions."""

    @cache
    def needed(text: str) -> tuple[str, ...]:
        names: list[str] = []
        for name in VIEWS:
            if f"{{{name}}}" in text:
                names += [n for n in (*needed(VIEWS[name]), name) if n not in names]
        return tuple(names)

    def bare(text: str) -> str:
        for name in (*SOURCES, *VIEWS):
            text = text.replace(f"{{{name}}}", name)
        return text

    ctes = [f"{name} AS ({bare(VIEWS[name])})" for name in needed(body)]
    text = bare(body).strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def check(name: str, sql: str | None = None):
    """Register ``fn(data)`` as query ``name`` with its oracle."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return plain(fn(Data(spark, folder)))

        CHECKS[name] = Check(run, oracle(sql) if sql else None)
        return fn

    return register
