import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobtide.llm.lexical_search import _Bucket, search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def plain_search(texts, items, k=20):
    found = [(d, Counter(terms(t))) for d, t in texts]
    total, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            n, score = sum(c.values()), 0
            m = 75 + (25 * n * total) // max(1, length)
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, d is not None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "the", "The"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    some = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, weights, k=n))
    texts = [(k // 2, some(rng.choice([0, 1, 5, 40, 300]))) for k in range(400)]
    copy = some(50)
    texts += [(1000 + k, copy) for k in range(150)] + [(2000, "w3 " * 4000), (2001, None), (None, copy), (None, some(20)), (2002, "... !"), (2003, "")]
    items = [(k, some(rng.randrange(1, 25))) for k in range(25)] + [(30, copy), (30, copy), (31, None), (32, ""), (None, "w1 w2"), (33, "unheard of"), (34, "w2 w2 w2 w59")]
    return texts, items


@pytest.fixture(scope="module")
def frames(spark, corpus):
    texts, items = corpus
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, rank int, item_id string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("options", [{}, {"bucket": 7, "head": 30}, {"bucket": 64, "head": 100, "most_bytes": 400}, {"k": 3, "head": 0}])
def test_ranks_are_those_of_brute_force(frames, corpus, options):
    got = sorted(map(tuple, search(*frames, **options).collect()), key=repr)
    assert got == plain_search(*corpus, options.get("k", 20))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(1, 6), st.integers(1, 50), min_size=1), min_size=1, max_size=25), st.dictionaries(st.integers(1, 6), st.integers(1, 3), min_size=1), st.integers(1, 400))
def test_a_bucket_gives_all_rows_that_reach_the_threshold(rows, question, least):
    size = np.array([len(r) for r in rows])
    flat = [(t, v) for r in rows for t, v in sorted(r.items())]
    length = np.sqrt([float(sum(v * v for v in r.values())) for r in rows])
    bucket = _Bucket(length, size, np.array([t for t, _ in flat], dtype=np.int32), np.array([v for _, v in flat], dtype=np.int64), 6)
    found, scores = bucket.search(np.array(list(question)), np.array(list(question.values())), least)
    want = {i: s for i, r in enumerate(rows) if (s := sum(n * r.get(t, 0) for t, n in question.items())) >= least}
    assert dict(zip(found.tolist(), scores.tolist())) == want


def test_empty_tables_and_ids_that_are_no_numbers(frames):
    docs, items = frames
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    named = search(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), items)
    assert sorted(r.score for r in named.collect()) == sorted(r.score for r in search(docs, items).collect())
