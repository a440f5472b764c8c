import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import reading as R
from jobtide.operators import scoring as S
from jobtide.schemas import conform

NOW = datetime(2024, 6, 15, 12)


def companies(spark, rows):
    """Companies from (id, score, last_job_count)."""
    df = spark.createDataFrame([(i, f"C{i}", s, n) for i, s, n in rows], "company_id long, company_name string, hiring_score int, last_job_count int")
    return conform(df, "companies")


def jobs(spark, rows):
    """Jobs from (id, company, status)."""
    return conform(spark.createDataFrame(rows, "job_id long, company_id long, status string"), "jobs")


def history(spark, rows):
    """History from (job, old, new, hours ago)."""
    rows = [(j, o, n, NOW - timedelta(hours=h)) for j, o, n, h in rows]
    return conform(spark.createDataFrame(rows, "job_id long, old_status string, new_status string, changed_at timestamp"), "job_history")


def signal(spark, company, job_rows, changes=()):
    return S.company_signals(companies(spark, [company]), jobs(spark, job_rows), history(spark, list(changes)), NOW).first()


@pytest.mark.parametrize("n, change", [(0, 0), (1, 5), (2, 10), (3, 25), (5, 35)])
def test_new_jobs(spark, n, change):
    got = signal(spark, (1, 0, 0), [(i, 1, "open") for i in range(n)])
    assert (got.new_jobs, got.score_change, got.new_score) == (n, change, change)


def test_closure_counts_as_update_too(spark):
    got = signal(spark, (1, 10, 1), [(1, 1, "closed")], [(1, "open", "closed", 1)])
    assert (got.closed_jobs_delta, got.job_updates, got.score_change, got.new_score) == (1, 1, -2, 8)


def test_windows_and_nulls(spark):
    rows = [(1, "open", "closed", 30), (1, "open", "closed", 48), (1, "open", "closed", 49), (1, None, "open", 1), (1, "open", "open", 1), (2, "unknown", "closed", 5)]
    got = signal(spark, (1, 20, 2), [(1, 1, "closed"), (2, 1, "open")], rows)
    # job 2 is open again: its closing is an update but not a closure
    assert (got.closed_jobs_delta, got.job_updates, got.score_change) == (2, 1, -7)


def test_never_negative_and_no_old_jobs(spark):
    got = signal(spark, (1, 3, 9), [(1, 1, "closed"), (2, 1, "closed")], [(1, "open", "closed", 30)] * 3)
    assert (got.new_jobs, got.score_change, got.new_score) == (0, -15, 0)


def test_stats_ranking_and_write_back(spark):
    firms = companies(spark, [(i, s, 0) for i, s in enumerate([50, 40, 30, 20, 10, 40])])
    work = jobs(spark, [(i, 0, "open") for i in range(5)] + [(9, 0, "closed")])
    stats = {r.company_id: tuple(r)[1:] for r in S.job_stats(firms, work).collect()}
    assert stats[0] == (6, 5, 1) and stats[3] == (0, 0, 0)
    assert [r.company_id for r in S.top_companies(firms, 3).collect()] == [0, 1, 5]
    assert [r.company_id for r in S.top_companies(firms, 10, 30).collect()] == [0, 1, 5, 2]
    signals = S.company_signals(firms, work, history(spark, []), NOW)
    kept = S.apply_signals(firms, signals, NOW).filter("company_id = 0").first()
    assert (kept.current_job_count, kept.last_job_count, kept.hiring_score, kept.last_checked) == (6, 0, 90, NOW)
    assert S.apply_signals(firms, signals, NOW, advance_baseline=True).filter("company_id = 0").first().last_job_count == 6
    assert S.company_signals(firms, work, history(spark, []), NOW, company_id=77).count() == 0
    one = R.hiring_stats(firms, work).first()
    assert (one.total_companies, one.total_jobs, one.open_jobs, one.closed_jobs, one.unknown_jobs) == (6, 6, 5, 1, 0)
    assert [c.company_id for c in one.top_hiring_companies] == [0, 1, 5, 2, 3, 4]


@pytest.mark.parametrize("block", ["day", "month", "year"])
def test_timeline_equals_a_fold(spark, block):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    runs = [(c, start + timedelta(hours=h), rng.choice([-15, -10, -5, 3, 5, 10])) for c in range(6) for h in rng.sample(range(4000), 150)]
    deltas = spark.createDataFrame(runs, "company_id long, run_at timestamp, delta long")
    first = {c: rng.randrange(20) for c in range(6)}
    got = {(r.company_id, r.run_at): r.score for r in S.score_timeline(deltas, companies(spark, [(c, s, 0) for c, s in first.items()]), block).collect()}
    want, score = {}, dict(first)
    for c, at, d in sorted(runs):
        score[c] = max(0, score[c] + d)
        want[c, at] = score[c]
    assert got == want


def test_run_deltas_equal_scoring_at_every_run(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    moment = lambda: start + timedelta(minutes=30 * rng.randrange(200))
    work = [(i, i % 3, rng.choice(["open", "closed"]), moment()) for i in range(40)]
    moves = [(rng.randrange(40), rng.choice([None, "open", "closed"]), rng.choice(["open", "closed"]), moment()) for i in range(80)]
    table = conform(spark.createDataFrame(work, "job_id long, company_id long, status string, created_at timestamp"), "jobs")
    log = conform(spark.createDataFrame(moves, "job_id long, old_status string, new_status string, changed_at timestamp"), "job_history")
    got = {(r.company_id, r.run_at): r.delta for r in S.run_deltas(table, log, every_hours=6).collect()}
    owner, status = {w[0]: w[1] for w in work}, {w[0]: w[2] for w in work}
    want = {}
    for c in range(3):
        for k in range(60):
            at = start + timedelta(hours=6 * k)
            new = sum(w[1] == c and at - timedelta(hours=6) < w[3] <= at for w in work)
            ups = sum(owner[j] == c and o is not None and o != n and timedelta(0) <= at - t <= timedelta(hours=24) for j, o, n, t in moves)
            closed = sum(owner[j] == c and n == "closed" and status[j] == "closed" and timedelta(0) <= at - t <= timedelta(hours=48) for j, o, n, t in moves)
            delta = 5 * new + (10 if new >= 3 else 0) - 5 * closed + 3 * ups
            if delta:
                want[c, at] = delta
    assert got == want


def test_run_deltas_spread_as_many_rows_a_task_whatever_the_size(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    work = [(i, i % 3, "closed", start) for i in range(40)] + [(7, 1, "open", start), (None, 2, "closed", start)]
    moves = [(i % 41, "open", "closed", start + timedelta(hours=i % 90)) for i in range(200)] + [(None, "open", "closed", start), (3, "open", "closed", None)]
    table = conform(spark.createDataFrame(work, "job_id long, company_id long, status string, created_at timestamp"), "jobs")
    log = conform(spark.createDataFrame(moves, "job_id long, old_status string, new_status string, changed_at timestamp"), "job_history")
    whole = S.run_deltas(table, log, every_hours=24)
    assert "REPARTITION_BY_NUM" in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(S, "_SPREAD", 50)
    cut = S.run_deltas(table, log, every_hours=24)
    assert "job_id#" in (plan := cut._jdf.queryExecution().toString()) and ", 13), REPARTITION_BY_NUM" in plan  # (42 + 202 * 3) / 50
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) != []


def test_every_company_comes_in_the_same_parts(spark):
    work = jobs(spark, [(i, 1, "open") for i in range(5000)] + [(1000000, 2, "open")])
    rows = R.company_with_jobs(companies(spark, [(1, 0, 0), (2, 0, 0), (3, 0, 0)]), work, parts=4).collect()
    assert sorted((r.company_id, r.part, r.parts) for r in rows) == [(c, p, 4) for c in (1, 2, 3) for p in range(4)]
    assert all([j.job_id for j in r.jobs] == list(range(r.part, 5000, 4)) for r in rows if r.company_id == 1)
    assert [r.job_count for r in sorted(rows, key=lambda r: (r.company_id, r.part)) if r.company_id > 1] == [1, 0, 0, 0, 0, 0, 0, 0]
    whole = R.company_with_jobs(companies(spark, [(1, 0, 0), (2, 0, 0)]), work).collect()
    assert sorted((r.company_id, r.part, len(r.jobs)) for r in whole) == [(1, 0, 5000), (2, 0, 1)]


def test_paging_and_search(spark):
    table = jobs(spark, [(i, i % 2, "open") for i in range(45)]).withColumns(
        {"created_at": F.timestamp_seconds(F.col("job_id") % 10), "job_title": F.concat(F.lit("100%_"), "job_id")}
    )
    page = R.list_jobs(table, page=2, page_size=20)
    info = page.info.first()
    assert (info.total, info.total_pages) == (45, 3)
    first = [r.job_id for r in R.list_jobs(table, page_size=20).items.collect()]
    second = [r.job_id for r in page.items.collect()]
    assert first[:5] == [9, 19, 29, 39, 8] and not set(first) & set(second)
    last = table.filter(F.col("job_id") == first[-1]).first()
    assert [r.job_id for r in R.list_jobs(table, page_size=20, after=(last.created_at, last.job_id)).items.collect()] == second
    assert R.list_jobs(table, search="100\\%\\_4").info.first().total == 6
    assert R.list_jobs(table, search="1%4").info.first().total == R.list_jobs(table, search="0\\0%_4").info.first().total + 0
    assert R.list_jobs(table, company_id=0, status="").info.first().total == 45
    for bad in ({"page": 0}, {"page_size": 101}, {"page_size": 0}):
        with pytest.raises(ValueError):
            R.list_jobs(table, **bad)


def test_pages_of_companies_go_on_after_the_last_one_seen(spark):
    rows = [(i, f"C{i}", None if i % 10 == 9 else i % 4) for i in range(45)]
    table = conform(spark.createDataFrame(rows, "company_id long, company_name string, s int").withColumnRenamed("s", "hiring_score"), "companies").withColumn(
        "hiring_score", F.when(F.col("company_id") % 10 != 9, F.col("company_id") % 4).cast("int")
    )
    seen, after = [], None
    while page := R.list_companies(table, page_size=7, after=after).collect():
        seen += [r.company_id for r in page]
        after = (page[-1].hiring_score, page[-1].company_id)
    assert seen == [i for i, *_ in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]


def test_scoring_prunes_and_never_multiplies(spark, tmp_path):
    from jobtide.sources.tables import read_snapshot, write_snapshot

    old = history(spark, [(1, "open", "closed", 24 * 400)] * 50 + [(1, "open", "closed", 2)])
    write_snapshot({"job_history": old}, str(tmp_path), "r1")
    stored = read_snapshot(spark, str(tmp_path), "r1")["job_history"]
    signals = S.company_signals(companies(spark, [(1, 0, 0)]), jobs(spark, [(1, 1, "closed")]), stored, NOW)
    plan = signals._jdf.queryExecution().executedPlan().toString()
    assert "change_month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(changed_at)" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert signals.first().closed_jobs_delta == 1
