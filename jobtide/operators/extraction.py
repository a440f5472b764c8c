"""From crawled pages to clean, unique job listings.

One Arrow pass over the pages turns each page into raw element rows; everything after it (cleaning, dates,
links, JSON-LD, de-duplication) is built-in expressions on those small rows. Pages are independent, so the pass
needs no shuffle: selector configs are broadcast to it while they are few, and ``html`` is dropped by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtide.functions import phrases as P
from jobtide.functions.dates import parse_iso, parse_posted
from jobtide.functions.text import bound, clean_text, strip_space
from jobtide.functions.urls import resolve_url
from jobtide.operators.markup import BLOCK, LINE, PARAGRAPH
from jobtide.operators.page_scan import main_texts, scan_pages, unusable
from jobtide.sources.shared import broadcast_if_small

_SELECTORS = {
    "job_listing_selector": ", ".join(P.LISTING_SELECTORS),
    "job_title_selector": P.TITLE_SELECTOR,
    "job_url_selector": P.URL_SELECTOR,
    "job_location_selector": P.LOCATION_SELECTOR,
    "job_date_selector": P.DATE_SELECTOR,
}
_SPAN = "struct<start:int,size:int>"
_NODES = (
    "company_id bigint, page_num int, fetched boolean, source string, page_text binary, "
    f"nodes array<struct<own:{_SPAN},title:{_SPAN},heading:{_SPAN},location:{_SPAN},dated:{_SPAN},description:{_SPAN},href:string,date_attribute:string>>"
)


def active_configs(site_configs: DataFrame) -> DataFrame:
    """One row per company with its own selectors. Should a company have several active configs, the oldest one
    counts; ``quality_report`` names such companies."""
    oldest = F.min_by(F.struct(*_SELECTORS), "config_id")
    return site_configs.filter("is_active").groupBy("company_id").agg(oldest.alias("own"))


def _selectors() -> list[Column]:
    return [
        F.coalesce(F.nullif(F.col(f"own.{name}"), F.lit("")), F.lit(default)).alias(name)
        for name, default in _SELECTORS.items()
    ]


def resolve_config(companies: DataFrame, site_configs: DataFrame) -> DataFrame:
    """Companies with the selectors to use: the active config's where given, else the defaults."""
    return companies.join(active_configs(site_configs), "company_id", "left").select(*companies.columns, *_selectors())


def with_selectors(pages: DataFrame, site_configs: DataFrame) -> DataFrame:
    """Pages with the selectors of their company, without moving any html while configs are few."""
    configs = broadcast_if_small(active_configs(site_configs))
    return pages.select("company_id", "page_num", "html").join(configs, "company_id", "left").select(
        "company_id", "page_num", "html", *_selectors()
    )


def unsupported_selectors(site_configs: DataFrame) -> DataFrame:
    """Companies whose active config has a selector that the page scan cannot use: company_id and error, one row for each such selector.

    Each different selector is tried once.
    """
    texts = F.explode(F.array_distinct(F.array(*_selectors()))).alias("selector")
    used = active_configs(site_configs).select("company_id", texts)
    tried = used.select("selector").distinct().mapInPandas(unusable, "selector string")
    error = F.concat(F.lit("unsupported selector: "), "selector").alias("error")
    return used.join(tried, "selector", "left_semi").select("company_id", error)


def page_nodes(pages_cfg: DataFrame) -> DataFrame:
    """One row per page: which way found its elements (``selector``, ``link`` or ``jsonld``; a page uses only one), its text once, and the places of the elements' texts
    in it, so that nested elements do not repeat what they hold. ``fetched`` is false where there was no html."""
    return pages_cfg.select("company_id", "page_num", "html", *_SELECTORS).mapInArrow(scan_pages, _NODES)


def _cut(place: str) -> Column:
    """Text at a place of the page; null where there is no place. Cut from bytes, which costs as much as the text is long."""
    return F.substring(F.col("page_text"), F.col(f"node.{place}.start") + 1, F.col(f"node.{place}.size")).cast("string")


def elements_of(nodes: DataFrame, outer: bool = False) -> DataFrame:
    """Raw elements of ``page_nodes``, one row per element; with ``outer`` pages without any have a row with null ``element_pos``."""
    generate = F.posexplode_outer if outer else F.posexplode
    each = nodes.select("company_id", "page_num", "fetched", "source", "page_text", generate("nodes").alias("element_pos", "node"))
    markup, own = F.col("source") != "jsonld", _cut("own")
    return each.select(
        "company_id", "page_num", "fetched", "source", "element_pos", F.when(markup, own).alias("self_text"),
        _cut("title").alias("title_text"), _cut("heading").alias("heading_text"), F.col("node.href").alias("href"), _cut("location").alias("location_text"),
        F.col("node.date_attribute").alias("date_attribute"), _cut("dated").alias("date_text"), _cut("description").alias("description_text"),
        F.when(~markup, own).alias("json_block"),
    )


def listing_elements(pages_cfg: DataFrame) -> DataFrame:
    """Raw candidate elements of every page, one row per element."""
    return elements_of(page_nodes(pages_cfg)).drop("fetched")


def job_link_fallback(elements: DataFrame) -> DataFrame:
    """Elements of pages where no listing selector hit but job-like links exist."""
    return elements.filter(F.col("source") == "link")


_POSITION = ("company_id", "page_num", "element_pos")


def _text_or_self(column: str) -> Column:
    """A selector without a hit stands for the whole element."""
    return clean_text(F.coalesce(F.col(column), F.col("self_text")))


def with_base(elements: DataFrame, companies: DataFrame) -> DataFrame:
    """Elements of known companies with the address their relative links start from."""
    return elements.join(companies.select("company_id", F.col("career_page_url").alias("base_url")), "company_id")


def _from_markup(as_of) -> Column:
    title = F.coalesce(
        F.nullif(_text_or_self("title_text"), F.lit("")),
        F.nullif(_text_or_self("heading_text"), F.lit("")),
        F.lit(P.UNTITLED),
    )
    preview = F.substring(_text_or_self("description_text"), 1, P.PREVIEW_LENGTH)
    return F.struct(
        title.alias("job_title"),
        F.coalesce(resolve_url("href", "base_url"), F.lit("")).alias("job_url"),
        F.nullif(_text_or_self("location_text"), F.lit("")).alias("location"),
        parse_posted("date_attribute", "date_text", as_of).alias("date_posted"),
        F.nullif(preview, F.lit("")).alias("description_preview"),
        F.lit(None).cast("string").alias("raw_data"),
    )


def _from_json() -> Column:
    """Listing of a JSON-LD block: a JobPosting object, or item 0 of an array that contains one; else null."""

    def is_posting(value) -> Column:
        return F.try_variant_get(value, "$['@type']", "string") == "JobPosting"

    def posting(block: Column) -> Column:
        is_array = F.schema_of_variant(block).startswith("ARRAY")
        any_posting = F.exists(F.try_variant_get(block, "$", "array<variant>"), is_posting)
        first = F.when(any_posting, F.try_variant_get(block, "$[0]", "variant"))
        return F.when(is_array, first).otherwise(F.when(is_posting(block), block))

    def listing(job: Column) -> Column:
        text = lambda path: F.try_variant_get(job, path, "string")
        posted_kind = F.schema_of_variant(F.try_variant_get(job, "$.datePosted", "variant"))
        return F.when(
            job.isNotNull(),
            F.struct(
                F.coalesce(text("$.title"), F.lit("")).alias("job_title"),
                F.coalesce(F.nullif(text("$.url"), F.lit("")), text("$.identifier.value"), F.lit("")).alias("job_url"),
                F.coalesce(text("$.jobLocation.address.addressLocality"), F.lit("")).alias("location"),
                parse_iso(F.when(posted_kind == "STRING", text("$.datePosted"))).alias("date_posted"),
                F.nullif(F.substring(text("$.description"), 1, P.PREVIEW_LENGTH), F.lit("")).alias("description_preview"),
                F.to_json(job).alias("raw_data"),
            ),
        )

    return bound(F.try_parse_json("json_block"), lambda block: bound(posting(block), listing))


def _listed(elements: DataFrame, listing: Column) -> DataFrame:
    found = elements.select(*_POSITION, listing.alias("listing"))
    return found.filter(F.col("listing").isNotNull()).select(*_POSITION, "listing.*")


def listing_fields(elements: DataFrame, as_of) -> DataFrame:
    """Typed listings from elements found by selectors or links (with ``base_url``)."""
    return _listed(elements.filter(F.col("source") != "jsonld"), _from_markup(as_of))


def jsonld_jobs(elements: DataFrame) -> DataFrame:
    """Typed listings from JSON-LD blocks."""
    return _listed(elements.filter(F.col("source") == "jsonld"), _from_json())


def typed_listings(elements: DataFrame, as_of) -> DataFrame:
    """Both kinds in one projection, so that the pages behind the elements are read once."""
    return _listed(elements, _any_listing(as_of))


def _any_listing(as_of) -> Column:
    return F.when(F.col("source") == "jsonld", _from_json()).otherwise(_from_markup(as_of))


def valid_listings(listings: DataFrame) -> DataFrame:
    return listings.filter((F.col("job_title") != "") & (F.col("job_url") != ""))


def dedupe_listings(listings: DataFrame) -> DataFrame:
    """First listing per company and URL in page and element order.

    An aggregate rather than a window: repeats collapse before the shuffle, so a URL listed on
    every page costs no more than any other.
    """
    rest = [c for c in listings.columns if c not in ("company_id", "job_url")]
    first = F.min_by(F.struct(*rest), F.struct("page_num", "element_pos"))
    picked = listings.groupBy("company_id", "job_url").agg(first.alias("first"))
    return picked.select("company_id", "job_url", *[F.col(f"first.{c}").alias(c) for c in rest]).select(*listings.columns)


def job_rows(listings: DataFrame) -> DataFrame:
    """Listings as rows ready to merge into jobs; nothing is known about their status yet."""
    return listings.select(
        "company_id", "job_title", "job_url", "location", "date_posted", "description_preview",
        F.lit("unknown").alias("status"),
    )


def extract_jobs(pages: DataFrame, companies: DataFrame, site_configs: DataFrame, as_of) -> DataFrame:
    """The whole chain, from crawled pages to unique job rows."""
    elements = with_base(listing_elements(with_selectors(pages, site_configs)), companies)
    return job_rows(dedupe_listings(valid_listings(typed_listings(elements, as_of))))


def scan_listings(pages: DataFrame, companies: DataFrame, site_configs: DataFrame, as_of) -> DataFrame:
    """Listings of all pages, and the companies that a page without html is of, from one pass: company_id, page_num, element_pos, fetched, listing."""
    elements = with_base(elements_of(page_nodes(with_selectors(pages, site_configs)), outer=True), companies)
    listing = F.when(F.col("element_pos").isNotNull(), _any_listing(as_of))
    found = elements.select(*_POSITION, "fetched", listing.alias("listing"))
    return found.where("listing IS NOT NULL OR NOT fetched")


def listings_of(scanned: DataFrame) -> DataFrame:
    """Unique job rows of ``scan_listings``."""
    listed = scanned.where("listing IS NOT NULL").select(*_POSITION, "listing.*")
    return job_rows(dedupe_listings(valid_listings(listed)))


def _laid_out(raw: Column) -> Column:
    """Text as a reader sees it: white space collapsed, each run of marked breaks as its line ends, nothing around."""
    breaks = f"[{LINE}-{PARAGRAPH}]"
    run = f" ?{breaks}[{LINE}-{PARAGRAPH} ]*"

    def lines(marks: Column) -> Column:
        single = F.length(marks) - F.length(F.replace(marks, F.lit(LINE), F.lit("")))
        block = F.when(marks.contains(PARAGRAPH), 2).when(marks.contains(BLOCK), 1).otherwise(0)
        return F.repeat(F.lit("\n"), (single + block).cast("int"))

    flat = F.regexp_replace(raw, "[ \t\n\r\f]+", " ")
    parts, runs = F.split(flat, run, -1), F.regexp_extract_all(flat, F.lit(run), F.lit(0))
    joined = F.array_join(F.zip_with(parts, runs, lambda text, marks: F.concat(text, F.coalesce(lines(marks), F.lit("")))), "")
    return strip_space(joined)


def page_text(pages: DataFrame) -> DataFrame:
    """Pages with ``html`` replaced by the text a reader would see of the main content. Python finds the main content and what to leave out; all else is expressions."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.pandas_udf(main_texts, "string")("html").alias("raw")).select(*kept, _laid_out(F.col("raw")).alias("text"))
