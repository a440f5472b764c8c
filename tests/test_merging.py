import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobtide.operators import merging as M
from jobtide.operators.quality import quality_report
from jobtide.schemas import JOBS, conform

NOW = datetime(2024, 6, 15, 12)
OLD = datetime(2024, 1, 1)
LISTING = "company_id long, job_title string, job_url string, location string, date_posted timestamp, description_preview string"


def jobs(spark, rows):
    """Jobs from (job_id, company_id, title, url, location, status, last_checked)."""
    df = spark.createDataFrame(
        rows, "job_id long, company_id long, job_title string, job_url string, location string, status string, last_checked timestamp"
    )
    return conform(df, "jobs").withColumns({"created_at": F.lit(OLD), "updated_at": F.lit(OLD)})


def plain_upsert(known, crawl):
    """One listing after the other, companies in order; URLs that several jobs share are errors."""
    state, errors = {}, set()
    for job_id, company, title, url, location, status, checked in known:
        if url in state:
            errors.add(url)
        state.setdefault(url, [company, title, location, checked, job_id])
    for company, title, url, location in sorted(crawl, key=lambda x: (x[0], x[1])):
        if url in errors or not url:
            continue
        if url not in state:
            state[url] = [company, title, location, None, None]
            continue
        job = state[url]
        if title != job[1]:
            job[1], job[3] = title, NOW
        if location and not job[2]:
            job[2], job[3] = location, NOW
    return {url: tuple(job[:4]) for url, job in state.items() if url not in errors}, errors


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    urls = [f"u{i}" for i in range(60)]
    known = [
        (i, rng.randrange(5), rng.choice("AB"), rng.choice(urls[:40]), rng.choice([None, "", "Rome"]), "open", rng.choice([None, OLD]))
        for i in range(45)
    ]
    listed = {(c, u) for c in range(6) for u in rng.sample(urls, 25)} | {(c, "u0") for c in range(6)}
    crawl = [(c, rng.choice("ABC"), u, rng.choice([None, "", "Oslo", "Bonn"])) for c, u in sorted(listed)] + [(1, "x", "", None)]
    result = M.upsert_jobs(jobs(spark, known), spark.createDataFrame([(*r, None, None) for r in crawl], LISTING), NOW)
    want, errors = plain_upsert(known, crawl)
    got = {r.job_url: (r.company_id, r.job_title, r.location or None, r.last_checked) for r in result.jobs.collect() if r.job_url not in errors}
    assert got == {u: (c, t, loc or None, at) for u, (c, t, loc, at) in want.items()}
    assert {r.job_url for r in result.errors.collect()} == {u for u in errors if any(u == r[2] for r in crawl)}
    # merging the same crawl again changes nothing more than once
    again = M.upsert_jobs(result.jobs, spark.createDataFrame([(*r, None, None) for r in crawl if r[0] == 5], LISTING), NOW)
    twice = M.upsert_jobs(again.jobs, spark.createDataFrame([(*r, None, None) for r in crawl if r[0] == 5], LISTING), NOW)
    assert sorted(map(str, again.jobs.collect())) == sorted(map(str, twice.jobs.collect()))
    assert twice.inserted.count() == 0


def test_new_jobs(spark):
    listing = spark.createDataFrame([(2, "T", "u", "", OLD, "d"), (1, "S", "u", None, None, None)], LISTING)
    row = M.upsert_jobs(jobs(spark, []), listing, NOW).inserted.first()
    assert (row.company_id, row.job_title, row.status, row.job_type, row.created_at) == (1, "T", "unknown", "unknown", NOW)
    assert row.job_id >= 0 and row.date_posted is None


def test_a_hot_url_is_reduced_before_it_moves(spark):
    crawl = spark.range(300_000).select(
        F.col("id").alias("company_id"), F.concat(F.lit("T"), "id").alias("job_title"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("job_url"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("timestamp").alias("date_posted"), F.lit(None).cast("string").alias("description_preview"),
    )
    result = M.upsert_jobs(jobs(spark, []), crawl, NOW)
    assert result.jobs.count() == 200_001
    assert result.jobs.filter("job_url = 'hot'").first().company_id == 0
    plan = M.match_listings(jobs(spark, []), crawl)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_match_is_worked_out_once(spark, tmp_path):
    jobs(spark, [(1, 1, "a", "u1", None, "open", OLD)]).write.parquet(str(tmp_path / "jobs"))
    spark.createDataFrame([(2, "T", "u2", "", OLD, "d")], LISTING).write.parquet(str(tmp_path / "listings"))
    result = M.upsert_jobs(spark.read.parquet(str(tmp_path / "jobs")), spark.read.parquet(str(tmp_path / "listings")), NOW)
    plan = result.jobs._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and f"{tmp_path}/listings" not in plan
    assert plan.count("FileScan") == 3 and result.jobs.count() == 2  # jobs once, the match for either side


def test_validation(spark):
    known = [(1, 1, "a", "1", None, "unknown", OLD), (2, 1, "b", "2", None, "open", None), (3, 1, "c", "3", None, "open", OLD), (4, 1, "d", "4", None, "closed", None)]
    table = jobs(spark, known)
    assert [r.job_id for r in M.validation_batch(table, 50).collect()] == [1, 2]
    assert [r.job_id for r in M.validation_batch(table, 1).collect()] == [1]
    verdicts = spark.createDataFrame(
        [(1, "closed", "keyword_fallback", "Found 1 closed indicators"), (2, "open", "ai_ollama", None), (3, None, None, None), (4, "unknown", "ai_ollama", None)],
        "job_id long, status string, method string, reason string",
    )
    after = {r.job_id: (r.status, r.last_checked) for r in M.apply_validation(table, verdicts, NOW).collect()}
    assert after == {1: ("closed", NOW), 2: ("open", NOW), 3: ("open", OLD), 4: ("unknown", NOW)}
    changes = sorted((r.job_id, r.old_status, r.new_status, r.change_reason) for r in M.status_changes(table, verdicts, NOW).collect())
    assert changes == [(1, "unknown", "closed", "keyword_fallback: Found 1 closed indicators"), (4, "closed", "unknown", "ai_ollama: AI classification")]
    # comparing two states
    assert M.status_changes(table, table, NOW).count() == 0
    assert M.status_changes(table, M.apply_validation(table, verdicts, NOW), NOW).count() == 2


def test_insert_checked_equals_one_by_one(spark):
    rng = random.Random(3)
    asked = [(i, rng.randrange(8), f"u{rng.randrange(25)}") for i in range(120)]
    companies, taken = {0, 1, 2, 3, 4}, {"u0", "u1", "u2"}
    out = M.insert_checked(
        "jobs",
        spark.createDataFrame(asked, "seq long, company_id long, job_url string"),
        spark.createDataFrame([(u,) for u in taken], "job_url string"),
        spark.createDataFrame([(c,) for c in companies], "company_id long"),
    )
    used, want = set(taken), {}
    for seq, company, url in asked:
        want[seq] = 404 if company not in companies else 400 if url in used else 201
        if want[seq] == 201:
            used.add(url)
    got = {r.seq: 201 for r in out.accepted.collect()} | {r.seq: r.code for r in out.rejected.collect()}
    assert got == want
    configs = spark.createDataFrame([(1, 0), (2, 9)], "seq long, company_id long")
    out = M.insert_checked("site_configs", configs, companies=spark.createDataFrame([(0,)], "company_id long"))
    assert [r.seq for r in out.accepted.collect()] == [1] and [(r.seq, r.code) for r in out.rejected.collect()] == [(2, 404)]


def test_patch(spark):
    table = jobs(spark, [(1, 1, "a", "1", "Rome", "open", OLD), (2, 1, "b", "2", None, "open", OLD), (3, 1, "c", "3", None, "open", OLD)])
    patches = spark.createDataFrame(
        [(1, 1, False, None, True, None), (1, 2, True, "A", False, "ignored"), (2, 3, True, "b", False, None), (2, 4, None, "zz", False, None)],
        "job_id long, seq long, set_job_title boolean, job_title string, set_location boolean, location string",
    )
    out = {r.job_id: (r.job_title, r.location, r.status, r.last_checked) for r in M.patch_rows(table, patches, "job_id", M.JOB_PATCHABLE, NOW).collect()}
    assert out == {1: ("A", None, "open", NOW), 2: ("b", None, "open", OLD), 3: ("c", None, "open", OLD)}


def test_quality_finds_repeats(spark):
    tables = {
        "companies": conform(spark.createDataFrame([(1, "", "u")], "company_id long, company_name string, career_page_url string"), "companies"),
        "jobs": jobs(spark, [(1, 1, "a", "1", None, "open", None), (2, 1, "b", "1", None, "gone", None), (2, 7, "x" * 501, "2", None, "open", None)]),
        "job_history": conform(spark.createDataFrame([(9, "closed"), (9, "open")], "job_id long, new_status string"), "job_history"),
        "site_configs": conform(spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "config_id long, company_id long"), "site_configs"),
    }
    found = {r.rule: r.violations for r in quality_report(tables).collect() if r.violations}
    assert found == {
        "companies.company_name required": 1,
        "jobs.job_title length": 1,
        "jobs.status allowed": 1,
        "jobs.job_id unique": 1,
        "jobs.company_id+job_url unique": 1,
        "jobs.company_id known": 1,
        "job_history.job_id known": 2,
        "site_configs.one active per company": 1,
        "site_configs.company_id known": 1,
    }


def test_jobs_schema_is_complete():
    assert JOBS.startswith("job_id BIGINT, company_id BIGINT")


def test_values_are_judged_before_anything_else(spark):
    asked = [(1, 1, "", "u1"), (2, 9, "T", "u1"), (3, 1, "T", "u1"), (4, 1, "T", "u1"), (5, 1, "x" * 501, "u2"), (6, 1, "T", None), (7, 1, None, "u3")]
    incoming = spark.createDataFrame(asked, "seq long, company_id long, job_title string, job_url string")
    none, one = spark.createDataFrame([], "job_url string"), spark.createDataFrame([(1,)], "company_id long")
    decided = {r.seq: (r.code, r.reason) for r in M.decide_inserts("jobs", incoming, none, one).collect()}
    assert {k: v[0] for k, v in decided.items()} == {1: 422, 2: 404, 3: None, 4: 400, 5: 422, 6: 422, 7: 422}
    assert decided[1][1] == "job_title is empty" and decided[6][1] == "job_url is empty"
    made = M.created_rows("jobs", M.insert_checked("jobs", incoming, none, one).accepted, NOW)
    (row,) = made.collect()
    assert (row.job_url, row.status, row.job_type) == ("u1", "unknown", "unknown") and row.job_id > 0 and row.created_at == row.updated_at


def test_patches_of_unknown_rows_come_back(spark):
    table = spark.createDataFrame([(1, "A", "open")], "job_id long, job_title string, status string")
    asked = [(1, True, "", False, None), (1, False, "", True, "open"), (2, True, "B", False, None), (1, False, None, True, "lost"), (1, True, None, False, None)]
    patches = spark.createDataFrame(asked, "job_id long, set_job_title boolean, job_title string, set_status boolean, status string")
    assert [r.code for r in M.decide_patches("jobs", table, patches, "job_id").orderBy("job_id", "set_job_title", "status", "job_title").collect()].count(422) == 3
    assert sorted(r.code or 0 for r in M.decide_patches("jobs", table, patches, "job_id").collect()) == [0, 404, 422, 422, 422]
    assert [r.job_id for r in M.unknown_ids(table, patches, "job_id").collect()] == [2]
