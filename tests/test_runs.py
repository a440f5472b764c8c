from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobtide.operators.classification import build_prompts, classify
from jobtide.plans.runs import crawl_run, scoring_run, validation_run
from jobtide.schemas import TABLES, conform
from jobtide.sources import shared
from jobtide.sources.shared import clear_written, discard, put_aside, shared_folder, written
from jobtide.sources.tables import load_pages, load_tables, read_snapshot, since, spread, write_snapshot

NOW = "2024-06-15 12:00:00"


@pytest.fixture
def tables(spark):
    rows = {
        "companies": ([(1, "A", "https://a.example/careers"), (2, "B", "https://b.example/")], "company_id long, company_name string, career_page_url string"),
        "jobs": ([(10, 1, "Old title", "https://a.example/jobs/1", "open")], "job_id long, company_id long, job_title string, job_url string, status string"),
        "job_history": ([], "job_id long, old_status string, new_status string, changed_at timestamp"),
        "site_configs": ([], "config_id long, company_id long, is_active boolean"),
    }
    return {name: conform(spark.createDataFrame(r, schema), name) for name, (r, schema) in rows.items()}


def test_crawl_validate_score_and_store(spark, tables, tmp_path):
    card = "<div class='job'><h2>{}</h2><a href='/jobs/{}'>x</a></div>".format
    pages = spark.createDataFrame(
        [(1, "p", 1, 200, card("New title", 1) + card("Second", 2)), (1, "p", 4, 200, card("Too deep", 9)), (2, "q", 1, 200, card("Third", 3))],
        "company_id long, url string, page_num int, http_status int, html string",
    )
    crawled = crawl_run(tables, pages, NOW)
    assert {(r.job_url, r.job_title, r.status) for r in crawled.tables["jobs"].collect()} == {
        ("https://a.example/jobs/1", "New title", "open"),
        ("https://a.example/jobs/2", "Second", "unknown"),
        ("https://b.example/jobs/3", "Third", "unknown"),
    }
    assert {r.company_id: r.current_job_count for r in crawled.tables["companies"].collect()} == {1: 2, 2: 1}
    assert {r.metric: r.value for r in crawled.report.collect()} == {"companies_processed": 2, "jobs_added": 2}

    write_snapshot(crawled.tables, str(tmp_path), "1-crawl")
    stored = read_snapshot(spark, str(tmp_path), "1-crawl")
    job_pages = spark.createDataFrame(
        [("https://a.example/jobs/2", "<body>" + "This position has been filled and the job expired. " * 2), ("https://b.example/jobs/3", "")],
        "url string, html string",
    )
    validated = validation_run(stored, job_pages, NOW, n=100)
    assert {r.job_url[-1]: r.status for r in validated.tables["jobs"].collect()} == {"1": "open", "2": "closed", "3": "unknown"}
    assert {r.metric: r.value for r in validated.report.collect()} == {"jobs_validated": 1, "jobs_closed": 1}
    change = validated.tables["job_history"].first()
    assert (change.old_status, change.new_status, change.change_reason) == ("unknown", "closed", "keyword_fallback: Found 2 explicit closed indicators")

    write_snapshot({name: validated.tables[name] for name in validated.changed}, str(tmp_path), "2-validate", validated.added)
    scored = scoring_run(read_snapshot(spark, str(tmp_path), "2-validate"), NOW)
    # company 1: two new jobs, one of them closed just now
    assert {r.company_id: r.hiring_score for r in scored.tables["companies"].collect()} == {1: 10 - 5 + 3, 2: 5}


def test_failed_crawls_are_named_by_company(spark, tables):
    shared = [(1, 1, "X", "https://s.example/1", "open"), (2, 2, "X", "https://s.example/1", "open")]
    stored = conform(spark.createDataFrame(shared, "job_id long, company_id long, job_title string, job_url string, status string"), "jobs")
    companies = conform(spark.createDataFrame([(i, f"C{i}", f"https://c{i}.example/") for i in range(1, 6)], "company_id long, company_name string, career_page_url string"), "companies")
    configs = conform(spark.createDataFrame([(1, 4, "li:nth-child(2)", True), (2, 5, ".job", True)], "config_id long, company_id long, job_listing_selector string, is_active boolean"), "site_configs")
    card = "<div class='job'><h2>T</h2><a href='{}'>x</a></div>".format
    companies = companies.unionByName(conform(spark.createDataFrame([(i, f"C{i}", f"https://c{i}.example/") for i in range(6, 10)], "company_id long, company_name string, career_page_url string"), "companies"))
    rows = [(1, "p", 1, 200, card("https://s.example/1")), (2, "p", 1, 200, card("https://s.example/1")), (3, "p", 1, 200, None), (4, "p", 1, 200, card("/jobs/9")), (5, "p", 1, 200, card("/jobs/5"))]
    # an error page is not read; a page left out; nothing fetched for 8 (its page lies too deep) and 9
    rows += [(6, "p", 1, None, card("/jobs/6")), (6, "p", 2, 404, card("/jobs/66")), (7, "p", 1, 200, card("/jobs/7")), (7, "p", 3, 200, card("/jobs/77")), (8, "p", 9, 200, card("/jobs/8"))]
    pages = spark.createDataFrame(rows, "company_id long, url string, page_num int, http_status int, html string")
    run = crawl_run({**tables, "companies": companies, "jobs": stored, "site_configs": configs}, pages, NOW)
    errors = {(r.item, r.error) for r in run.errors.collect()}
    assert errors == {
        ("1", "several jobs share this URL: https://s.example/1"),
        ("2", "several jobs share this URL: https://s.example/1"),
        ("3", "a page has no html"),
        ("4", "unsupported selector: li:nth-child(2)"),
        ("6", "a page came with code 404"),
        ("7", "no page 2"),
        ("8", "no page was fetched"),
        ("9", "no page was fetched"),
    }
    assert {r.metric: r.value for r in run.report.collect()} == {"companies_processed": 1, "jobs_added": 4, "errors": 8}
    new = ["https://c5.example/jobs/5", "https://c6.example/jobs/6", "https://c7.example/jobs/7", "https://c7.example/jobs/77"]
    assert sorted(r.job_url for r in run.tables["jobs"].collect()) == [*new, "https://s.example/1", "https://s.example/1"]
    plan = run.report._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan  # the figures were gathered while the results were written


def test_latest_page_of_a_job_counts(spark, tables):
    table = conform(spark.createDataFrame([(1, 1, "u", "unknown"), (2, 2, "u", "unknown")], "job_id long, company_id long, job_url string, status string"), "jobs")
    closed, opened = "The position is filled and this job expired, sorry. " * 2, "Apply now, we are glad to hear from you. Apply today!" * 2
    pages = spark.createDataFrame(
        [("u", closed, datetime(2024, 1, 2)), ("u", opened, datetime(2024, 1, 1)), ("u", "", datetime(2024, 1, 3)), ("v", opened, datetime(2024, 1, 4))],
        "url string, html string, fetched_at timestamp",
    )
    run = validation_run({**tables, "jobs": table}, pages, NOW)
    assert sorted((r.job_id, r.status) for r in run.tables["jobs"].collect()) == [(1, "closed"), (2, "closed")]
    assert run.tables["job_history"].count() == 2


def test_unfinished_runs_stay_hidden(spark, tables, tmp_path):
    tables["jobs"].write.parquet(str(tmp_path / "jobs" / "run=r1"))
    with pytest.raises(ValueError, match="r1 is not whole"):
        read_snapshot(spark, str(tmp_path), "r1")
    write_snapshot(tables, str(tmp_path), "r1")
    assert set(read_snapshot(spark, str(tmp_path), "r1")) == set(TABLES)
    with pytest.raises(ValueError):
        write_snapshot({}, str(tmp_path), "r2")


def _changes(spark, *rows):
    frame = spark.createDataFrame(rows, "job_id long, old_status string, new_status string, changed_at timestamp")
    return conform(frame, "job_history")


def test_a_failing_rerun_leaves_the_finished_rows(spark, tables, tmp_path):
    root = str(tmp_path)
    write_snapshot({**tables, "job_history": _changes(spark, (10, "unknown", "open", datetime(2024, 6, 1)))}, root, "r1")
    broken = spark.range(3).select(F.raise_error(F.lit("gone")).cast("long").alias("job_id"), F.lit(None).cast("timestamp").alias("changed_at"))
    empty, lost = tables["jobs"].limit(0), _changes(spark, (10, "open", "closed", datetime(2024, 6, 2)))
    with pytest.raises(ValueError, match="there already"):
        write_snapshot({"jobs": empty}, root, "r1")
    # the run that does it again dies on its way, with some of its rows written
    for added in (conform(broken, "job_history"), None):
        with pytest.raises(Exception, match="gone"):
            failing = {"jobs": empty, "companies": broken} if added is None else {"jobs": empty}
            write_snapshot(failing, root, "r2", added={"job_history": lost if added is None else added})
    for run in ("r1", "r3"):
        if run == "r3":  # a later one does not see what was left
            write_snapshot({"companies": tables["companies"]}, root, "r3", added={"job_history": _changes(spark, (11, None, "open", datetime(2024, 6, 3)))})
        stored = read_snapshot(spark, root, run)
        assert stored["jobs"].count() == 1
        assert sorted(r.job_id for r in stored["job_history"].collect()) == ([10] if run == "r1" else [10, 11])
    with pytest.raises(ValueError, match="r2 is not whole"):
        read_snapshot(spark, root, "r2")
    write_snapshot({"jobs": empty}, root, "r2", added={"job_history": lost})  # and what was left can be written over
    assert read_snapshot(spark, root, "r2")["job_history"].count() == 2 and read_snapshot(spark, root, "r3")["job_history"].count() == 3


def test_runs_write_only_what_they_change(spark, tables, tmp_path):
    root = str(tmp_path)
    write_snapshot({**tables, "job_history": _changes(spark, (10, "unknown", "open", datetime(2024, 6, 14)))}, root, "r1")
    scored = scoring_run(read_snapshot(spark, root, "r1"), NOW)
    write_snapshot({name: scored.tables[name] for name in scored.changed}, root, "r2")
    page = spark.createDataFrame([("https://a.example/jobs/1", "<body>" + "The job expired and is no longer available. " * 3)], "url string, html string")
    checked = validation_run(read_snapshot(spark, root, "r2"), page, NOW)
    write_snapshot({name: checked.tables[name] for name in checked.changed}, root, "r3", checked.added)
    there = {name: sorted(p.name for p in (tmp_path / name).iterdir() if p.is_dir()) for name in ("companies", "jobs", "site_configs")}
    assert there == {"companies": ["run=r1", "run=r2"], "jobs": ["run=r1", "run=r3"], "site_configs": ["run=r1"]}
    assert spark.read.parquet(str(tmp_path / "job_history" / "whole=false" / "run=r3")).count() == 1
    statuses = lambda run: sorted((r.old_status, r.new_status) for r in read_snapshot(spark, root, run)["job_history"].collect())
    assert statuses("r1") == statuses("r2") == [("unknown", "open")] and statuses("r3") == [("open", "closed"), ("unknown", "open")]
    assert read_snapshot(spark, root, "r1")["jobs"].first().status == "open" and read_snapshot(spark, root, "r3")["jobs"].first().status == "closed"
    # history written as a whole takes the place of what was there
    write_snapshot({"job_history": read_snapshot(spark, root, "r3")["job_history"].where("new_status = 'closed'")}, root, "r4")
    assert statuses("r4") == [("open", "closed")] and len(statuses("r3")) == 2


def test_loaded_history_is_pruned_by_month(spark, tables, tmp_path):
    write_snapshot({**tables, "job_history": _changes(spark, (10, "unknown", "open", datetime(2024, 6, 14)))}, str(tmp_path), "r1")
    signals = scoring_run(read_snapshot(spark, str(tmp_path), "r1"), NOW)
    history = since(read_snapshot(spark, str(tmp_path), "r1")["job_history"], F.lit(NOW).cast("timestamp"))
    plan = spark._jvm.PythonSQLUtils.explainString(history._jdf.queryExecution(), "formatted")
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "change_month" in filters and "run" in filters
    assert signals.tables["companies"].count() == 2


def test_stored_layouts_are_mapped_and_missing_keys_fail(spark, tables, tmp_path):
    for name, df in tables.items():
        key = {"companies": "company_id", "site_configs": "config_id"}.get(name, "job_id")
        df.withColumnRenamed(key, "id" if name != "job_history" else key).write.parquet(str(tmp_path / name))
    upper = spark.createDataFrame([(10, 1, "OPEN"), (11, 1, None), (12, 1, "closed")], "id long, company_id long, status string")
    upper.write.mode("overwrite").parquet(str(tmp_path / "jobs"))
    with pytest.raises(ValueError, match="no column company_id"):
        load_tables(spark, str(tmp_path))
    columns = {"companies": {"id": "company_id"}, "jobs": {"id": "job_id"}, "site_configs": {"id": "config_id"}}
    loaded = load_tables(spark, str(tmp_path), columns=columns, values={"jobs": {"status": {"OPEN": "open"}}})
    assert sorted((r.job_id, r.status) for r in loaded["jobs"].collect()) == [(10, "open"), (11, "unknown"), (12, "closed")]


def test_tables_get_declared_columns_and_defaults(spark, tmp_path):
    for name, column in {"companies": "company_id", "jobs": "job_id", "job_history": "job_id", "site_configs": "config_id"}.items():
        spark.range(1).withColumnRenamed("id", column).write.parquet(str(tmp_path / name))
    loaded = load_tables(spark, str(tmp_path))
    for name, df in loaded.items():
        assert [f"{f.name} {f.dataType.simpleString().upper()}" for f in df.schema] == TABLES[name].split(", ")
    company, job, config = (loaded[t].first() for t in ("companies", "jobs", "site_configs"))
    assert (company.last_job_count, company.current_job_count, company.hiring_score) == (0, 0, 0)
    assert (job.status, job.job_type) == ("unknown", "unknown")
    assert (config.is_active, config.pagination_type) == (True, "none")


def test_pages_source(spark, tmp_path):
    spark.createDataFrame([(1, "u", n, 200, "x") for n in range(1, 8)], "company_id long, url string, page_num int, http_status int, html string").write.parquet(
        str(tmp_path / "pages")
    )
    assert sorted(r.page_num for r in load_pages(spark, str(tmp_path / "pages")).collect()) == [1, 2, 3, 4, 5]
    plan = load_pages(spark, str(tmp_path / "pages"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(page_num,3)" in plan


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(100, numPartitions=64)
    assert spread(wide) is wide
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_what_was_put_aside_can_be_cleared(spark):
    (path,) = {f.rpartition("/")[0] for f in written(spark.range(3), "aside").inputFiles()}
    kept = written(spark.range(2), "aside")
    assert kept.count() == 2 and Path(path.removeprefix("file://")).exists()
    before = dict(shared._WRITTEN)
    try:
        shared._WRITTEN[spark.sparkContext.applicationId] = [path]
        clear_written(spark)
    finally:
        shared._WRITTEN.update(before)
    assert not Path(path.removeprefix("file://")).exists() and kept.count() == 2


def test_a_table_that_is_used_up_can_be_discarded(spark):
    first, second = written(spark.range(5), "used"), written(spark.range(3), "kept")
    place = Path(first.inputFiles()[0].removeprefix("file://")).parent
    discard(first)
    assert not place.exists() and second.count() == 3
    discard(first.limit(0), written(spark.range(0), "empty"))  # nothing there, nothing to do
    mark = put_aside(spark)
    third, fourth = written(spark.range(2), "third"), written(spark.range(6), "fourth")
    clear_written(spark, mark, keep=fourth)
    assert put_aside(spark) == mark + 1 and fourth.count() == 6 and second.count() == 3
    assert not Path(third.inputFiles()[0].removeprefix("file://")).exists()


def test_cascade(spark):
    long = "Nothing here tells whether anyone may still write to us about this. "
    texts = {1: "Job", 2: "Position has been filled, no longer available. " + long, 3: long, 4: long, 5: long, 6: long, 7: long + "apply now"}
    df = spark.createDataFrame(list(texts.items()), "posting_id long, text string")
    answers = [
        (2, "ai_ollama", 200, '{"response": "open"}'),
        (3, "ai_ollama", 200, '{"response": "no idea"}'),
        (3, "ai_huggingface", 200, '{"generated_text": "open"}'),
        (4, "ai_ollama", 500, '{"response": "open"}'),
        (4, "ai_huggingface", 200, '[{"generated_text": "closed"}]'),
        (5, "ai_ollama", 200, "{oops"),
        (5, "ai_huggingface", 200, "[]"),
        (6, "ai_ollama", 200, '{"response": "OPEN"}'),
    ]
    got = classify(df, spark.createDataFrame(answers, "posting_id long, provider string, http_status int, body string"))
    assert {r.posting_id: (r.status, r.method) for r in got.collect()} == {
        1: ("unknown", "insufficient_content"),
        2: ("closed", "keyword_fallback"),
        3: ("unknown", "parse_failed"),  # an unreadable first answer ends the cascade
        4: ("closed", "ai_huggingface"),
        5: ("unknown", "keyword_fallback"),
        6: ("open", "ai_ollama"),
        7: ("open", "keyword_fallback"),
    }
    assert sorted(r.posting_id for r in build_prompts(df).collect()) == [3, 4, 5, 6, 7]
    assert {r.posting_id: r.method for r in classify(df).collect()}[3] == "keyword_fallback"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("text#" in line and "Exchange" in line for line in plan.splitlines())


def test_the_first_of_several_answers_counts(spark):
    texts = spark.createDataFrame([(1, "Nothing here tells whether anyone may still write to us about this. ")], "posting_id long, text string")
    rows = [(1, "ai_ollama", 200, '{"response": "open"}', datetime(2024, 1, 2)), (1, "ai_ollama", 500, '{"response": "closed"}', datetime(2024, 1, 1)),
            (1, "ai_ollama", 200, '{"response": "closed"}', datetime(2024, 1, 3)), (1, "ai_ollama", 200, '{"response": "closed"}', None)]
    answers = spark.createDataFrame(rows, "posting_id long, provider string, http_status int, body string, answered_at timestamp")
    assert classify(texts, answers).first().status == "open"
    assert classify(texts, answers.drop("answered_at")).first().status == "closed"


def test_as_of_may_be_a_datetime(spark, tables):
    assert scoring_run(tables, datetime(2024, 6, 15)).tables["companies"].first().last_checked == datetime(2024, 6, 15)
