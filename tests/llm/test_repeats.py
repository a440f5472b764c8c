import hashlib
import random
from collections import Counter, defaultdict

import pytest

from jobtide.llm import chunk_dedup, suffixes
from jobtide.llm.chunk_dedup import boundaries
from jobtide.llm.near_duplicates import near_duplicates, without_copies


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", [1]) for i, t in rows], "doc_id long, text string, kept string, spans array<int>").repartition(3)


def brute_spans(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, t in rows:
        b, spans = (t or "").encode(), []
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        at = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(at[::2], at[1::2]))
        out.append((k, len(b), [tuple(s) for s in spans], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefg é") for _ in range(4000))
    rows = [(1, base), (2, base[100:900] + "X" + base[901:2000]), (3, None), (4, ""), (5, "a" * 1500), (6, "ab" * 700), (7, base[:399])]
    rows += [(8, base[200:600]), (8, base[200:600]), (9, "q" + base[3000:3400] + "z"), (10, "r" + base[3000:3399] + "y"), (None, base[3500:])]
    rows += [(11, base[3600:] + base[3600:]), (12, "a" * 420)]
    for k in range(12):
        t = list(base[:2500])
        for _ in range(3):
            t[rng.randrange(2500)] = "#"
        rows.append((100 + k, "".join(t)))
    got = [
        (r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in suffixes.dedup(frame(spark, rows)).collect()
    ]
    assert sorted(got, key=str) == brute_spans(rows, 400)


def test_parts_of_long_texts_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    data = memoryview(base.encode())
    import numpy as np

    text = np.frombuffer(data, dtype=np.uint8)
    whole = suffixes.anchors(text, 400)
    monkeypatch.setattr(suffixes, "_PART", 500)
    assert suffixes.anchors(text, 400) == whole
    places = np.array([a for a, *_ in whole])
    parts = suffixes._seeds(text, places)
    monkeypatch.undo()
    assert (suffixes._seeds(text, places) == parts).all()


def test_passages_go_from_all_but_the_first(spark):
    rng = random.Random(5)
    passages = [prose(rng, rng.randint(51, 80)) for _ in range(30)]
    rows = [(3 * i + k, f"{prose(rng, rng.randint(5, 90))} {p} {prose(rng, rng.randint(5, 90))}") for i, p in enumerate(passages) for k in range(3)]
    clean = [(1000 + k, prose(rng, 200)) for k in range(30)]
    got = {r.doc_id: r for r in chunk_dedup.dedup(frame(spark, [*rows, *clean, (None, None), (5000, "")])).collect()}
    for i, p in enumerate(passages):
        first, *others = (got[3 * i + k] for k in range(3))
        assert first.spans == [] and first.kept.decode() == dict(rows)[3 * i]
        for other in others:
            assert sum(s.stop - s.start for s in other.spans) > 0.3 * len(p) and p not in other.kept.decode()
    assert all(got[k].kept.decode() == t for k, t in clean)
    assert got[None].kept == got[5000].kept == b"" and got[None].n_bytes == 0


def test_chunks_fall_into_step_after_an_insertion():
    rng = random.Random(6)
    text = prose(rng, 500).encode()
    other = text[:40] + b"something new " + text[40:]
    cut = lambda t: {t[a:b] for a, b in zip([0, *boundaries(t, 16, 40, 256)], boundaries(t, 16, 40, 256))}
    assert len(cut(text) - cut(other)) <= 3
    ends = boundaries("é日".encode() * 3000, 16, 40, 256)
    assert all(b - a <= 260 for a, b in zip([0, *ends], ends)) and ends[-1] == 5 * 3000
    for a, b in zip([0, *ends], ends):
        ("é日".encode() * 3000)[a:b].decode()
    assert boundaries(b"", 16, 40, 256) == [] and boundaries(b"x", 16, 40, 256) == [1]


def brute_groups(rows):
    sets = []
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((k, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in held[x])
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for x in s:
            held[x].append(i)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[top(i)] = min((x for x in (least.get(top(i)), k) if x is not None), default=None)
    return sorted(((k, len(s), least[top(i)]) for i, (k, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("stars", [0, 2])
def test_groups_are_those_of_brute_force(spark, stars):
    rng = random.Random(5)
    base, rows = prose(rng, 300).split(), []
    for k in range(120):  # a cloud of copies, many of them linked through others only
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(300)] = f"x{rng.randrange(999)}"
        rows.append((k, " ".join(t)))
    rows += [(200 + k, " ".join(base[:200]) + " " + prose(rng, rng.randint(20, 120))) for k in range(40)]
    rows += [(800, None), (801, ""), (802, "one two"), (803, "ONE two"), (804, " a"), (805, "A"), (806, "É é"), (807, "é é"), (None, "one two"), (805, "A")]
    got = near_duplicates(frame(spark, rows), stars=stars).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_buckets_of_two_are_compared_without_stars(spark):
    text = prose(random.Random(14), 200)
    got = near_duplicates(frame(spark, [(1, text), (2, text + " end")]), stars=0).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1}


def test_a_large_group_of_copies_keeps_one(spark):
    rng = random.Random(8)
    text = prose(rng, 60)
    rows = [(k, text) for k in range(500)] + [(1000, prose(rng, 60)), (1001, "")]
    kept = without_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000, 1001] and kept.columns == ["doc_id", "text", "kept", "spans"]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert suffixes.dedup(none).collect() == chunk_dedup.dedup(none).collect() == near_duplicates(none).collect() == []


def test_blocks_of_long_texts_are_small(spark):
    """Look-alikes of many shingles that are not linked: all pairs are compared, in blocks bounded by shingles."""
    from jobtide.llm import near_duplicates as nd

    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(12)]
    texts[7] = texts[2] + " one more"
    nodes = spark.createDataFrame([(k, t, len(t.split()) - 4) for k, t in enumerate(texts)], "node long, text string, size long")
    buckets = nodes.selectExpr("1L AS bucket", "node", "12L AS n")
    labels = nodes.selectExpr("node", "node AS comp")
    for most in ((128, 1 << 18), (128, 600), (2, 1 << 18)):
        links = nd._block_links(buckets, labels, nodes, 85, 5, asked=most, told=(1024, 900)).collect()
        assert {frozenset((r.a, r.b)) for r in links} == {frozenset((2, 7))}


def plain_chunks(rows, min_run=100, **sizes):
    """Passages out of all texts but the first, by loops over the chunks."""
    first, out = {}, []
    places = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    for key in places:
        data = key[2].encode()
        ends = boundaries(data, *sizes.values())
        for a, b in zip([0, *ends[:-1]], ends):
            first.setdefault(data[a:b], (key, a))
    for k, t in rows:
        key, data = (k is not None, k or 0, t or ""), (t or "").encode()
        ends, spans = boundaries(data, *sizes.values()), []
        for a, b in zip([0, *ends[:-1]], ends):
            if first[data[a:b]] != (key, a):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        spans = [(a, b) for a, b in spans if b - a >= min_run]
        at = [0, *(x for s in spans for x in s), len(data)]
        out.append((k, len(data), spans, b"".join(data[a:b] for a, b in zip(at[::2], at[1::2]))))
    return sorted(out, key=repr)


def test_chunks_go_as_brute_force_has_it(spark):
    rng = random.Random(17)
    passages = [prose(rng, rng.randrange(20, 120)) for _ in range(5)]
    rows = [(k, " ".join(rng.choice([*passages, prose(rng, 30)]) for _ in range(rng.randrange(5)))) for k in range(60)]
    rows += [(100 + k, passages[0]) for k in range(40)] + [(200, passages[1] * 4), (None, passages[2] + " é日🙂"), (201, None), (202, ""), (203, "x" * 5000)]
    rows += [rows[3], rows[3], (None, passages[2] + " é日🙂"), (204, passages[4] + prose(rng, 8000) + passages[4])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, __carried int").repartition(3)
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in chunk_dedup.dedup(docs, carry=True).collect()]
    assert sorted(got, key=repr) == plain_chunks(rows, least=16, average=40, most=256)


def test_ids_of_any_type(spark):
    rng = random.Random(19)
    shared, rows = prose(rng, 150), []
    for k in range(12):
        rows.append((k, shared + " " + prose(rng, 30)))
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    named = plain.selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS __carried")
    for made in (suffixes.dedup, lambda d: near_duplicates(d).selectExpr("doc_id", "n_shingles AS n_bytes")):
        assert sorted(r.n_bytes for r in made(plain).collect()) == sorted(r.n_bytes for r in made(named).collect())
    kept = chunk_dedup.dedup(named).collect()
    assert len(kept) == 12 and sum(not r.spans for r in kept) == 1
    assert without_copies(named.unionByName(named)).columns == ["doc_id", "text", "__carried"]


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(23)
    base = prose(rng, 200)
    near = base + " one more"
    rows = [(5, base), (5, base), (5, base), (3, near), (3, near), (None, base), (None, "lonely text of five words or more")] * 2
    rows += [(9, None), (9, None), (10, ""), (None, "no id in this group at all here"), (None, "no id in this group at all here")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, carried string").repartition(4)
    kept = [(r.doc_id, r.text) for r in without_copies(docs).collect()]
    want = [(3, near), (None, "lonely text of five words or more"), (9, None), (9, None), (10, ""), (None, "no id in this group at all here")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_only_strings_close_to_where_repeats_end_are_compared_one_by_one(spark, monkeypatch):
    rows, put = {}, suffixes.written

    def counting(df, label):
        kept = put(df, label)
        rows[label] = kept.count()
        return kept

    monkeypatch.setattr(suffixes, "written", counting)
    rng = random.Random(71)
    letters = "abcdefghijklmnop"
    shared = ["".join(rng.choices(letters, k=700)) for _ in range(12)]
    texts = ["".join(rng.choices(letters, k=rng.randrange(90, 600))) + shared[i % 12] + "".join(rng.choices(letters, k=rng.randrange(90, 600))) for i in range(48)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(x.start, x.stop) for x in r.spans] for r in suffixes.dedup(docs).collect()}
    for i, text in enumerate(texts):
        strings = {other[k : k + 400] for j, other in enumerate(texts) if j != i for k in range(len(other) - 399)}
        found = [k for k in range(len(text) - 399) if text[k : k + 400] in strings]
        assert got[i] == [(found[0], found[-1] + 400)]
    assert 0 < rows["strings"] < 48 * 4 * 20  # some 74 for each run before
