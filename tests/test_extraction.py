from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from jobtide.operators import extraction as X
from jobtide.operators.markup import Page, parse_selector
from jobtide.operators.page_scan import main_texts

NOW = "2024-06-15 12:00:00"
CONFIG = "config_id long, company_id long, is_active boolean, " + ", ".join(f"{name} string" for name in X._SELECTORS)


@pytest.fixture
def companies(spark):
    return spark.createDataFrame([(1, "https://a.example/careers"), (2, "https://b.example/jobs/")], "company_id long, career_page_url string")


@pytest.fixture
def no_configs(spark):
    return spark.createDataFrame([], CONFIG)


def pages(spark, *rows):
    return spark.createDataFrame(rows, "company_id long, page_num int, html string")


def extracted(spark, companies, configs, *rows):
    return X.extract_jobs(pages(spark, *rows), companies, configs, NOW).orderBy("company_id", "job_url").collect()


def test_selectors():
    page = Page(
        "<html><body><div id=top class='x job-card'><h2>A <b>b</b></h2><p>one<p>two<br>three</div>"
        "<ul><li data-k='a, b'>1<li>2</ul><article class=job><script>var t = '</p>'</script>Hi &amp; you</article>"
    )
    texts = lambda s: [page.data[slice(*page.place(n))].decode() for n in page.find(s)]
    assert texts("h2") == ["A b"]
    assert texts("div p") == ["one", "twothree"]
    assert texts("body > b, div > h2 > b") == ["b"]
    assert texts("[class*='job-card'] h2, article.job") == ["A b", "var t = '</p>'Hi & you"]
    assert texts("[data-k='a, b']") == ["1"]
    assert texts("ul li") == ["1", "2"]
    assert texts("#top h2") == texts("[id^=to] h2") == texts("div.x.job-card[class$='card'] h2") == ["A b"]
    for bad in ("", "a:has-text('x')", "a,,b", "[a"):
        with pytest.raises(ValueError):
            parse_selector(bad)


_MARKUP = st.lists(
    st.sampled_from(
        ["<", ">", "</", "<!", "<![", "<!--", "-->", "<![CDATA[", "]]>", "<?", "a", "div", "p", " ", '"', "'", "=", "class", "&", "&#",
         "&amp;", "/", "br", "<p>", "<div>", "</div>", "<script>", "</script>", "<title>", "é", "\n", "<li>", "<table>", "<tr>", "<td>"]
    ),
    max_size=40,
).map("".join)


@given(_MARKUP)
def test_any_text_is_a_page(html):
    page = Page(html)
    assert all(i < end <= len(page.tag) for i, end in enumerate(page.end))
    assert main_texts(pd.Series([html])).notna().all()


def test_many_unclosed_tags():
    page = Page("<b>" * 30_000 + "<div>" * 30_000 + "<p>x" * 30_000)
    assert len(page.find("p")) == 30_000


def test_first_selector_with_a_hit_wins(spark, companies, no_configs):
    html = "<div class='job-listing'><h2>Second</h2><a href='/2'>x</a></div><div data-job-id=1><h2>First</h2><a href='/1'>x</a></div>"
    got = extracted(spark, companies, no_configs, (1, 1, html))
    assert [(r.job_title, r.job_url, r.status) for r in got] == [("First", "https://a.example/1", "unknown")]


def test_fields_and_fallbacks(spark, companies, no_configs):
    html = """
    <li class="job-item"><h3> Data
       Engineer </h3><a href="jobs/1">more</a><span class="job-location">Oslo</span><time datetime="2024-01-02T03:04:05Z">x</time><p>About</p></li>
    <li class="job-item"><a class="job-link" href="../2">Clerk</a><span class="posted">Posted 2 days ago</span></li>
    <li class="job-item"><h2> </h2><a href="3">Only text</a></li>
    <li class="job-item"><h2></h2><h1>Heading</h1><a href="https://c.example/4">x</a></li>
    <li class="job-item">No link</li>"""
    got = {r.job_url: r for r in extracted(spark, companies, no_configs, (2, 1, html))}
    one = got["https://b.example/jobs/jobs/1"]
    assert (one.job_title, one.location, one.date_posted, one.description_preview) == ("Data Engineer", "Oslo", datetime(2024, 1, 2, 3, 4, 5), "About")
    two = got["https://b.example/2"]
    assert (two.job_title, two.date_posted) == ("Clerk", datetime(2024, 6, 13, 12))
    assert two.location == two.description_preview == "ClerkPosted 2 days ago"  # no hit: the whole element
    # an empty title element is tried again as a heading, and an empty heading leaves the title unknown
    assert got["https://b.example/jobs/3"].job_title == "Unknown Position"
    assert got["https://c.example/4"].job_title == "Unknown Position"
    assert len(got) == 4  # the element without a link is not valid


def test_links_then_json(spark, companies, no_configs):
    links = "<a href='/about'>no</a><a href='/career/7'>Seven</a><a href='/position/8'>Eight</a>"
    block = """<script type="application/ld+json">%s</script>"""
    json = block % '{"@type": "JobPosting", "title": "J", "url": "https://x.example/j", "datePosted": "2024-02-03"}' + block % "{broken"
    both = links + json
    got = extracted(spark, companies, no_configs, (1, 1, both), (2, 1, json))
    assert [(r.company_id, r.job_title, r.job_url) for r in got] == [
        (1, "Seven", "https://a.example/career/7"),
        (1, "Eight", "https://a.example/position/8"),
        (2, "J", "https://x.example/j"),
    ]
    assert got[2].date_posted == datetime(2024, 2, 3)


def test_own_selectors_and_their_gaps(spark, companies):
    own = {"job_listing_selector": "div.row", "job_title_selector": "b", "job_location_selector": "", "job_date_selector": None}
    row = lambda i, active, **s: (i, 1, active, *[s.get(n) for n in X._SELECTORS])
    configs = spark.createDataFrame([row(1, False, job_listing_selector="p"), row(2, True, **own), row(3, True)], CONFIG)
    html = "<div class=row><h2>no</h2><b>Yes</b><a href=/1>x</a><i class=city>Rome</i></div><div class=job><h2>other</h2><a href=/2>x</a></div>"
    got = extracted(spark, companies, configs, (1, 1, html), (2, 1, html))
    assert [(r.company_id, r.job_title, r.location, r.job_url) for r in got] == [
        (1, "Yes", "Rome", "https://a.example/1"),
        (2, "other", "otherx", "https://b.example/2"),
    ]


def test_first_of_repeated_listings(spark, companies, no_configs):
    card = "<div class=job><h2>{}</h2><a href='{}'>x</a></div>".format
    got = extracted(
        spark, companies, no_configs,
        (1, 2, card("late", "/1") + card("other", "/2")), (1, 1, card("early", "/1") + card("again", "/1")), (2, 1, card("mine", "https://a.example/1")),
    )
    assert [(r.company_id, r.job_title) for r in got] == [(1, "early"), (1, "other"), (2, "mine")]


def test_page_text(spark):
    html = [
        "<body><nav>menu</nav><main><h1>Title</h1><p>One  two<br>three</p><script>x</script><footer>f</footer></main>tail</body>",
        "<body><header><main>not this</main></header><div class='job-description'>This <b>one</b></div></body>",
        "<body>Just <i>body</i><aside>no</aside> text<style>p{}</style></body>",
        "<title>t</title>loose text",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, html string")
    got = [r.text for r in X.page_text(df).orderBy("i").collect()]
    assert got == ["Title\n\nOne two\nthree", "This one", "Just body text", "loose text", "", ""]


def test_html_is_not_shuffled_and_read_once(spark, companies, no_configs, tmp_path):
    pages(spark, (1, 1, "<a href=/jobs/1>x</a>")).write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    plan = X.extract_jobs(stored, companies, no_configs, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "html" not in plan.split("MapInArrow")[0]
    assert plan.count("FileScan") == 1


def test_deduplication_combines_before_the_shuffle(spark):
    listings = spark.range(1000).select(
        F.lit(1).alias("company_id"), F.lit("u").alias("job_url"), F.col("id").cast("int").alias("page_num"), F.lit(0).alias("element_pos")
    )
    deduped = X.dedupe_listings(listings)
    plan = deduped._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    assert [tuple(r) for r in deduped.collect()] == [(1, "u", 0, 0)]


def test_nested_elements_do_not_repeat_their_text(spark, no_configs):
    depth, inner = 60, "some words " * 40
    nested = "<div class='job'><h2>T</h2>" * depth + inner + "</div>" * depth
    nodes = X.page_nodes(X.with_selectors(pages(spark, (1, 1, nested), (1, 2, None), (1, 3, "<p>nothing</p>")), no_configs)).orderBy("page_num").collect()
    assert [(len(r.nodes), len(r.page_text), r.fetched) for r in nodes] == [(depth, depth + len(inner), True), (0, 0, False), (0, 0, True)]
    texts = X.elements_of(X.page_nodes(X.with_selectors(pages(spark, (1, 1, nested + "é<b>ü</b>")), no_configs))).orderBy("element_pos").collect()
    assert [r.self_text for r in texts] == ["T" * (depth - k) + inner for k in range(depth)] and {r.title_text for r in texts} == {"T"}
