import random

import corpus_pipeline
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        rows = made.collect()
        out.append((name, docs.columns, made.columns, rows))
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for _, before, after, _ in stages[:-1]:
        assert before == after == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_works_on_what_the_last_one_kept(stages):
    ids = [[r.doc_id for r in rows] for *_, rows in stages]
    for before, after in zip(ids, ids[1:]):
        assert set(after) <= set(before)
    assert len(ids[0]) > len(ids[2]) == len(set(ids[2])) == len(ids[3]) and set(ids[4]) == set(ids[3])
    texts = [r.text for r in stages[2][3]]
    assert len(texts) == len(set(texts))
    assert all(r.n_chars == len(r.text) for r in stages[3][3])


def test_run_gives_the_pieces_of_the_last_stage(spark, stages):
    assert sorted((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "doc_tokens").distinct().collect()) == sorted(
        {(r.doc_id, r.doc_tokens) for r in stages[4][3]}
    )


def test_near_dedup_keeps_the_lowest_id_of_brute_force_groups(spark):
    rng, rows = random.Random(12), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        # each changed word takes up to five shingles of 200 away: 4 give about 0.82, 5 about 0.78
        for changed in (0, 1, 3, 4, 4, 5):
            words = list(base)
            for at in rng.sample(range(8, 196, 8), changed):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows if (w := t.split())}
    up = {k: k for k, _ in rows}
    found = set()
    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                found.add(100 * common < 85 * (len(sets[a]) + len(sets[b]) - common))
                low, high = sorted((up[a], up[b]))
                up = {k: low if c == high else c for k, c in up.items()}
    assert found == {True, False}
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), SMALL)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(up.values()))


def test_stages_take_odd_rows(spark, stages):
    """Nulls in any column, empty and repeated texts, texts met often, ids twice, extra columns with names that the stages use themselves."""
    texts = {r.doc_id: r.text for r in stages[0][3]}
    some = sorted(texts)[:25]
    rows = [(i, texts[i], "en", "web", len(texts[i]), "x", 1) for i in some]
    rows += rows[:6] + [(None, texts[some[0]] + " and one more word", None, None, None, None, None)] * 2
    rows += [(90000, None, None, "web", None, "x", 1), (90001, "", "en", None, 0, None, 1), (90002, " \n", "en", "web", 2, "x", None)]
    rows += [(91000 + k, texts[some[1]], "en", "web", 5, "x", 1) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __carried string, kept int").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        out = made.collect()
        if name == "packing":
            assert {r.doc_id for r in out} == ids and all(r.length > 0 for r in out)
            break
        assert made.columns == docs.columns
        ids = {r.doc_id for r in out}
        assert ids <= {r[0] for r in rows} and len(out) <= len(rows)
        if name == "quality rules":
            assert not ids & {90000, 90001, 90002} and set(some) <= ids
        if name == "near-dedup":
            # copies of a text, and repeated rows, leave one; the row without id is a near copy of the first text
            assert len(out) == len({r.text for r in out}) and None not in ids and not any(i is not None and i >= 91000 for i in ids)
        if name == "substring dedup":
            assert all(r.n_chars == len(r.text) for r in out)
        docs = spark.createDataFrame(out, made.schema)
    assert ids


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        assert made.collect() == []
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], docs.schema)
    assert [r.text for r in corpus_pipeline.substring_dedup(spark, rows, SMALL).orderBy("doc_id").collect()] == ["", None]
