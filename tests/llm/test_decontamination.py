import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobtide.llm.training_suffixes import SuffixArray, contamination, decontaminate, longest_matches, report

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_report(texts, items, window):
    out = []
    named = [(i, words(t)) for i, t in items if words(t)]
    for doc, text in texts:
        found, hit, names = words(text), set(), set()
        for i, w in named:
            n = min(window, len(w))
            wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            for p in range(len(found) - n + 1):
                if tuple(found[p : p + n]) in wanted:
                    hit.update(range(p, p + n))
                    names.add(i)
        ids = sorted(str(i) for i in names if i is not None)
        out.append((doc, len(found), len(hit), len(ids), sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    some = lambda n: rng.choices(["the", "Cat", "sat", "ON", "é", "日本", "42", "a_b", "x"], [9, 5, 5, 5, 2, 1, 1, 1, 1], k=n)
    items = [(k, " ".join(some(rng.randrange(1, 30)))) for k in range(25)]
    items += [(3, items[3][1]), (90, items[4][1]), (91, ""), (92, None), (93, "... !"), (None, "a null id that is met in some text"), (94, "one")]
    passages = [t for _, t in items if t]
    texts = [(k // 2, rng.choice([", ", " ", "\n"]).join([*some(rng.randrange(0, 60)), *rng.choices(passages, k=rng.randrange(3)), *some(rng.randrange(9))])) for k in range(120)]
    # a hot passage, repeated rows, nulls, a text cut into many shards with passages over the cuts
    texts += [(500 + k, "one " + passages[0]) for k in range(60)] + [(700, "same the cat sat")] * 3
    texts += [(None, passages[5]), (None, None), (800, None), (801, ""), (802, " ".join([*some(150), passages[0], *some(50), passages[7].upper(), *some(150)]))]
    return texts, items


@pytest.fixture(scope="module")
def frames(spark, corpus):
    texts, items = corpus
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, doc string, items int").repartition(3)
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"shard": 37}, {"most_bytes": 200, "shard": 64}, {"window": 3}, {"window": 3, "most_bytes": 300}])
def test_hits_are_those_of_brute_force(frames, corpus, options):
    got = sorted(map(tuple, report(*frames, **options).collect()), key=repr)
    assert got == plain_report(*corpus, options.get("window", 10))


@pytest.mark.parametrize("options", [{}, {"most_bytes": 200, "shard": 64}])
def test_affected_documents_go_with_nothing_else_changed(frames, corpus, options):
    docs, items = frames
    kept = decontaminate(docs, items, **options)
    assert kept.schema == docs.schema
    clean = Counter(r[0] for r in plain_report(*corpus, 10) if not r[-1])
    assert Counter(r.doc_id for r in kept.collect()) == clean and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("shard", [1 << 20, 29])
def test_longest_matches(frames, corpus, shard):
    docs, items = frames
    texts = [(d, words(t)) for d, t in corpus[0]]
    got = longest_matches(docs, items.where("item_id < 8"), least=5, shard=shard).collect()
    want = {}
    for item, text in corpus[1]:
        w = words(text)
        for k in range(len(w) if item is not None and item < 8 else 0):
            for _, found in texts:
                for p in range(len(found)):
                    n = 0
                    while k + n < len(w) and p + n < len(found) and w[k + n] == found[p + n]:
                        n += 1
                    if n >= 5:
                        want[str(item), k] = max(n, want.get((str(item), k), 0))
    assert {(r.item_id, r.item_word): r.length for r in got} == want and want
    by_item = {str(i): words(t) for i, t in corpus[1]}
    for r in got:
        passage = by_item[r.item_id][r.item_word : r.item_word + r.length]
        assert any(d == r.doc_id and f[r.doc_word : r.doc_word + r.length] == passage for d, f in texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=12))
def test_suffix_array_order_and_search(shard, test):
    words_, query = np.array(shard, dtype=np.int32), np.array([*test, 0, 0], dtype=np.int32)
    array = SuffixArray(words_, 12)

    def upto(values, k):
        rest = values[k:]
        return rest[: rest.index(0)] if 0 in rest else rest

    order = [upto(shard, p) for p in array.places.tolist()]
    assert order == sorted(order) and sorted(array.places.tolist()) == [p for p, w in enumerate(shard) if w]
    start = np.flatnonzero(query)
    if len(start):
        most = np.array([len(upto(query.tolist(), j)) for j in start.tolist()])
        size, place = array.longest(query, start, most)
        for j, n, p in zip(start.tolist(), size.tolist(), place.tolist()):
            shared = [sum(1 for _ in _same(upto(query.tolist(), j), s)) for s in order]
            assert n == max(shared, default=0)
            assert not n or sum(1 for _ in _same(upto(query.tolist(), j), upto(shard, p))) == n
        low, high = (array.search(query, start, most, after) for after in (False, True))
        for j, a, b in zip(start.tolist(), low.tolist(), high.tolist()):
            mine = upto(query.tolist(), j)
            assert b - a == sum(s[: len(mine)] == mine for s in order)


def _same(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def test_empty_tables_and_ids_that_are_no_numbers(spark, frames):
    docs, items = frames
    assert report(docs.limit(0), items).count() == 0
    assert report(docs, items.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate(docs, items.limit(0)).count() == docs.count()
    assert longest_matches(docs, items.limit(0)).count() == 0
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    for options in ({}, {"most_bytes": 200}):
        assert contamination(named, items, **options).where("size(spans) > 0").count() == report(docs, items).where("contaminated").count()
