import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtide.operators.extraction import extract_jobs
from jobtide.operators.merging import upsert_jobs
from jobtide.schemas import CRAWLED_PAGES, conform
from jobtide.sources.tables import stream_pages
from jobtide.streaming import activity, changes, crawl

START = datetime(2024, 1, 1)
SEEN = "job_id long, observed_at timestamp, status string"


def write_files(spark, folder, batches, schema):
    """One file per batch, older first."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def stream(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/*")


def changed(spark, folder, root, per_trigger=1):
    changes.status_changes_stream(stream(spark, folder, SEEN, per_trigger), f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return sorted(map(tuple, changes.changes_written(spark, f"{root}/changes").collect()))


def observations(n=400, seed=4):
    rng = random.Random(seed)
    rows = [(rng.randrange(6) if rng.random() < 0.6 else 0, START + timedelta(minutes=7 * i), rng.choice(["open", "closed", "unknown", None])) for i in range(n)]
    return rows


def plain_changes(rows):
    last, out = {}, []
    for job, at, status in sorted(rows, key=lambda r: r[1]):
        if status is not None and status != last.get(job, "unknown"):
            out.append((job, last.get(job, "unknown"), status, at))
        if status is not None:
            last[job] = status
    return sorted(out)


def test_status_changes_over_several_triggers(spark, tmp_path):
    rows = observations()  # one job has most of them
    write_files(spark, tmp_path / "in", [rows[:150], rows[150:160], rows[160:]], SEEN)
    assert changed(spark, tmp_path / "in", tmp_path) == plain_changes(rows)
    assert changes.late_observations(spark, f"{tmp_path}/changes").count() == 0


def test_a_hot_job_hands_over_few_rows():
    micros = [int((START + timedelta(minutes=k)).timestamp() * 1e6) for k in range(3000)]
    rows = [(0, m, "open" if k < 2000 else "closed") for k, m in enumerate(micros)] + [(1, micros[0], "open"), (1, micros[0], "closed")]
    random.Random(1).shuffle(rows)
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, ["job_id", "micros", "status"])
    kept = [tuple(r.values()) for b in changes._run_ends([batch.slice(0, 1000), batch.slice(1000)]) for r in b.to_pylist()]
    # 3000 minutes are three days with one change: the ends of four runs, and the other job's two
    assert len(kept) == 10
    last, out = {}, []
    for job, at, status in kept:
        if status != last.get(job):
            out.append((job, at, status))
        last[job] = status
    assert out == [(0, micros[0], "open"), (0, micros[2000], "closed"), (1, micros[0], "closed"), (1, micros[0], "open")]
    assert list(changes._run_ends([])) == [] and sum(b.num_rows for b in changes._run_ends([batch.slice(0, 0)])) == 0


def test_one_trigger_or_many_give_the_same_in_order_of_time(spark, tmp_path):
    rows = [(j, START + timedelta(hours=5 * k + j), random.Random(k * 7 + j).choice(["open", "closed"])) for k in range(40) for j in range(3)]
    rows.sort(key=lambda r: r[1])
    write_files(spark, tmp_path / "in", [rows[k : k + 30] for k in range(0, len(rows), 30)], SEEN)
    assert changed(spark, tmp_path / "in", tmp_path / "a", 1) == changed(spark, tmp_path / "in", tmp_path / "b", 9) == plain_changes(rows)


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_status_changes_of_a_table(spark, block):
    rows = observations(600, seed=9)
    got = changes.status_changes_batch(spark.createDataFrame(rows, SEEN), block)
    assert sorted(map(tuple, got.collect())) == plain_changes(rows)


def test_restart_and_late_observations(spark, tmp_path):
    write_files(spark, tmp_path / "in", [[(1, START, "open")]], SEEN)
    assert len(changed(spark, tmp_path / "in", tmp_path)) == 1
    later = [(1, START + timedelta(hours=2), "open"), (1, START + timedelta(hours=3), "closed"), (1, START - timedelta(hours=1), "unknown")]
    spark.createDataFrame(later, SEEN).coalesce(1).write.parquet(str(tmp_path / "in" / "001"))
    assert changed(spark, tmp_path / "in", tmp_path) == [(1, "open", "closed", START + timedelta(hours=3)), (1, "unknown", "open", START)]
    assert [tuple(r) for r in changes.late_observations(spark, f"{tmp_path}/changes").collect()] == [(1, START - timedelta(hours=1), "unknown")]


LISTING = "company_id long, job_title string, job_url string, location string, date_posted timestamp, description_preview string"


def test_upsert_stream(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(c, rng.choice("AB"), f"u{rng.randrange(30)}", None, None, None) for c in range(20)] for _ in range(3)]
    write_files(spark, tmp_path / "in", batches, LISTING)
    jobs = conform(spark.createDataFrame([(1, 1, "old", "u1")], "job_id long, company_id long, job_title string, job_url string"), "jobs")
    def start(checkpoint="checkpoint"):
        files = stream(spark, tmp_path / "in", LISTING)
        crawl.upsert_stream(files, jobs, str(tmp_path / "state"), str(tmp_path / checkpoint), "2024-06-15 12:00:00", parts=8, files=1).awaitTermination()

    start()
    want = jobs
    for rows in batches:
        want = upsert_jobs(want, spark.createDataFrame(rows, LISTING), "2024-06-15 12:00:00").jobs
    now = lambda: crawl.current_jobs(spark, str(tmp_path / "state"))
    show = lambda df: sorted(map(str, df.select("job_id", "company_id", "job_title", "job_url", "status", "last_checked").collect()))
    assert show(now()) == show(want)
    start()  # nothing new: nothing changes
    assert show(now()) == show(want)

    before = set(now().inputFiles())
    spark.createDataFrame([(1, "Z", "u1", None, None, None)], LISTING).coalesce(1).write.parquet(str(tmp_path / "in" / "099"))
    start()
    after = set(now().inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1  # the other folders keep their files
    assert [r.job_title for r in now().filter("job_url = 'u1'").collect()] == ["Z"]


def test_a_repeated_trigger_gives_equal_rows(spark, tmp_path):
    rows = [(c, f"t{c % 4}", f"u{c % 9}", "Oslo" if c % 3 else None, None, None) for c in range(40)]
    write_files(spark, tmp_path / "in", [rows], LISTING)
    jobs = conform(spark.createDataFrame([(1, 1, "old", "u1"), (2, 2, "twice", "u2"), (3, 3, "twice", "u2")], "job_id long, company_id long, job_title string, job_url string"), "jobs")
    seen = []
    for checkpoint in "ab":  # the second stream knows nothing of the first and merges the same trigger again
        files = stream(spark, tmp_path / "in", LISTING)
        crawl.upsert_stream(files, jobs, str(tmp_path / "state"), str(tmp_path / checkpoint), "2024-06-15 12:00:00", parts=4, files=3).awaitTermination()
        seen.append(sorted(map(str, crawl.current_jobs(spark, str(tmp_path / "state")).collect())))
        errors = spark.read.parquet(str(tmp_path / "state" / "errors"))
        assert {r.job_url for r in errors.collect()} == {"u2"}
    assert seen[0] == seen[1] and len(seen[0]) == 10


PAGE = "<html><body>{}</body></html>"
CARD = "<div class='job'><h2>{}</h2><a href='/jobs/{}'>x</a></div>"


def test_listings_of_a_stream_of_pages_are_those_of_all_pages(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for company in range(4):
        for page in range(1, 5):
            cards = "".join(CARD.format(f"T{company}{page}{k}", rng.randrange(12)) for k in range(6))
            rows.append((company, f"p{page}", page, 200, None if (company, page) == (1, 2) else PAGE.format(cards), START))
    rng.shuffle(rows)  # a later file may have an earlier page
    write_files(spark, tmp_path / "in", [rows[:5], rows[5:9], rows[9:]], CRAWLED_PAGES)
    companies = spark.createDataFrame([(c, f"https://c{c}.example/x") for c in range(4)], "company_id long, career_page_url string")
    configs = conform(spark.createDataFrame([], "config_id long"), "site_configs")

    def run():
        pages = stream_pages(spark, f"{tmp_path}/in/*", max_pages=3, files_per_trigger=1)
        crawl.listings_stream(pages, companies, configs, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "2024-06-15 12:00:00").awaitTermination()
        return sorted(map(str, crawl.listings_found(spark, f"{tmp_path}/out").collect()))

    def batch():
        pages = spark.read.schema(CRAWLED_PAGES).parquet(f"{tmp_path}/in/*").where("page_num <= 3")
        found = extract_jobs(pages, companies, configs, "2024-06-15 12:00:00")
        return sorted(map(str, found.select("company_id", "job_title", "job_url", "location", "date_posted", "description_preview", "status").collect()))

    assert run() == batch() and len(batch()) > 20
    write_files(spark, tmp_path / "in" / "more", [[(9, "p", 1, 200, "x", START), (2, "p1", 1, 200, PAGE.format(CARD.format("Late", 99)), START)]], CRAWLED_PAGES)
    spark.read.parquet(f"{tmp_path}/in/more/000").write.parquet(f"{tmp_path}/in/009")
    assert run() == batch()  # after a restart
    assert any("Late" in r for r in run())


def test_activity_windows(spark, tmp_path):
    rng = random.Random(2)
    schema = "job_id long, old_status string, new_status string, changed_at timestamp"
    jobs = [(j, j % 3, rng.choice(["open", "closed"])) for j in range(8)]
    rows = [
        (0 if rng.random() < 0.5 else rng.randrange(8), rng.choice([None, "open", "closed"]), rng.choice(["open", "closed"]), START + timedelta(minutes=m))
        for m in sorted(rng.sample(range(6000), 120))
    ]
    latest = max(r[3] for r in rows)
    in_time = [(0, "open", "closed", latest - timedelta(hours=40))]  # its windows end after the watermark
    too_late = [(0, "open", "closed", latest - timedelta(days=9)), (99, "open", "closed", latest), (1, "open", "closed", None)]
    write_files(spark, tmp_path / "in", [rows[:60], rows[60:], in_time, too_late], schema)
    table = spark.createDataFrame(jobs, "job_id long, company_id long, status string")
    query = activity.activity_stream(stream(spark, tmp_path / "in", schema), table, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 24, 6, "48 hours")
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    got = activity.activity_windows(spark, f"{tmp_path}/out")
    want = {}
    for job, old, new, at in rows + in_time:
        slot = START + timedelta(hours=6) * ((at - START) // timedelta(hours=6))
        for k in range(4):
            sums = want.setdefault((job % 3, slot - timedelta(hours=6 * k)), [0, 0])
            sums[0] += old is not None and old != new
            sums[1] += new == "closed" and jobs[job][2] == "closed"
    assert {(r.company_id, r.window_start): [r.updates, r.closures] for r in got.collect()} == want and dropped == 4
    assert all(r.window_end - r.window_start == timedelta(hours=24) for r in got.collect())

    # a restart goes on from the checkpoint: one more change, after all others
    write_files(spark, tmp_path / "more", [[(1, "open", "closed", latest + timedelta(hours=1))]], schema)
    spark.read.parquet(f"{tmp_path}/more/000").write.parquet(f"{tmp_path}/in/009")
    activity.activity_stream(stream(spark, tmp_path / "in", schema), table, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 24, 6, "48 hours").awaitTermination()
    total = lambda df: df.agg(F.sum("updates")).first()[0]
    assert total(activity.activity_windows(spark, f"{tmp_path}/out")) == sum(u for u, _ in want.values()) + 4


@pytest.mark.parametrize("per_trigger", [1, 5])
def test_first_seen_is_the_earliest_whatever_the_order_of_files(spark, tmp_path, per_trigger):
    schema = "company_id long, job_url string, seen_at timestamp"
    batches = [[(i % 3, "hot" if i % 2 else f"u{i % 7}", START + timedelta(hours=i + 30 * b)) for i in range(30)] for b in (2, 0, 1)]
    write_files(spark, tmp_path / "in", batches, schema)
    sightings = stream(spark, tmp_path / "in", schema, per_trigger)
    crawl.first_seen_stream(sightings, f"{tmp_path}/seen", f"{tmp_path}/checkpoint").awaitTermination()
    want = {}
    for company, url, at in (r for b in batches for r in b):
        want[company, url] = min(at, want.get((company, url), at))
    got = crawl.first_seen(spark, f"{tmp_path}/seen").collect()
    assert len(got) == len(want) and {(r.company_id, r.job_url): r.seen_at for r in got} == want
