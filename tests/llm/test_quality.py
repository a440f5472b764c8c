import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from jobtide.llm import bloom_model, resampling
from jobtide.llm.fingerprints import fingerprint, fingerprints, likeness, spliced_fingerprints
from jobtide.llm.hashed_words import END, hash_word, token_hashes
from jobtide.llm.quality_rules import COMMON_WORDS, _percentile, _windows, fit, quality_rules
from pyspark.sql import functions as F


def english(rng, n):
    """Sentences with common words about as often as in English."""
    common, words = COMMON_WORDS["en"], []
    for i in range(n):
        odd = f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['e', 'ing', 'er'])}"
        word = rng.choices(common, [1 / k for k in range(1, len(common) + 1)])[0] if rng.random() < 0.35 else odd
        words.append((word.capitalize() if i % 10 == 0 else word) + (", "[i % 10 != 5].strip() if i % 10 != 9 else "."))
    return " ".join(words)


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, True, "en") for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, lang string").repartition(2)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_base_counts_are_those_of_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b \x85 c", "x " * 5000, "é日🙂 " * 30, "l1 w\nl1 w\n\n \nl2\r\nl2\r\n", "<a> #1 | $ % & *" * 9]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [english(rng, 40) + " " + " ".join(["same words come back again and again here"] * k) for k in range(1, 5)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(rows_of(spark, texts)).collect()}
    assert {i: base(t) for i, t in enumerate(texts)} == got


def test_windows_are_hashed_without_copies(spark):
    values = F.transform(F.sequence(F.lit(1), F.col("id")), lambda x: F.xxhash64(x % 3))
    copied = F.transform(F.sequence(F.lit(1), F.size(values) - 7), lambda i: F.xxhash64(F.slice(values, i, 8)))
    rows = spark.range(9, 40).select(_windows(values, 8).alias("got"), copied.alias("want"), F.size(values).alias("n"))
    assert all(r.got == r.want and len(r.got) == r.n - 7 for r in rows.collect())


def test_divergence_tells_junk_from_language(spark):
    rng = random.Random(2)
    good = [english(rng, 120) for _ in range(20)]
    shouted, marked = [g.upper() + "!!" for g in good], [" ".join(w + "$%#" for w in g.split()) for g in good]
    listed = [" | ".join(f"zu{i}" for i in range(k, k + 80)) for k in range(20)]
    short = ["zu zi"] * 3
    got = {r.doc_id: r for r in quality_rules(rows_of(spark, [*good, *shouted, *marked, *listed, *short])).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[i].kept for i in range(20, 80))
    assert all(got[i].char_distance is None and got[i].word_distance is None for i in range(80, 83))
    assert all(0 <= got[i].char_distance <= 1 and 0 <= got[i].word_distance <= 1 for i in range(80))
    strict = quality_rules(rows_of(spark, good), max_word_distance=0.0)
    assert strict.columns.count("kept") == 1 and not any(r.kept for r in strict.collect())


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_spliced_texts_and_likeness(spark, ranges):
    rng = random.Random(3)
    texts = {i * 7: english(rng, rng.randint(1, 400)) for i in range(60)} | {1000: "", 1001: None, 1002: "é日🙂 ab"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("next", F.lit(1)).repartition(4)
    got = {r.doc_id: r for r in spliced_fingerprints(docs, ranges=ranges).collect()}
    ids = sorted(texts)
    errors = []
    for k, after in zip(ids, ids[1:] + ids[:1]):
        text, other = texts[k] or "", texts[after] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in (text, edited)]
        if sets[0] and sets[1]:
            errors.append(got[k].near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.25
    assert got[1000].near_next == 1.0 and got[1001].near_next == 0.0


def test_fingerprints_of_ties_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a  b\nc"), (None, "x"), (3, None)], "doc_id long, text string")
    found = {(r.doc_id, r.text): r.fingerprint for r in fingerprints(docs).collect()}
    assert found[1, "a b c"] == found[2, "a  b\nc"] != found[None, "x"] and found[3, ""] == ""
    assert len(spliced_fingerprints(docs).collect()) == 5
    assert spliced_fingerprints(docs.limit(0)).collect() == []
    one = spliced_fingerprints(docs.where("doc_id = 2")).first()
    assert one.near_next == 1.0
    plan = spliced_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    full = docs.select(likeness(fingerprint(F.col("text")), fingerprint(F.col("text"))).alias("x")).distinct().collect()
    assert all(r.x in (1.0, None) for r in full)


@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_hashes_of_a_block_of_texts_are_those_of_its_words(part):
    rng = random.Random(3)
    letters = "aAbBzZéÉ\u00a0\u0085\x00\x1c\U0001f600" + " \t\n\v\f\r" * 2
    texts = ["", " ", "\n a\r", "ab ba", "x" * 40, " ".join("Qwértyuiopasdfghjkl"[:n] for n in range(20))] + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)]
    words = [t.encode().lower().split() for t in texts]
    hashes, lengths = token_hashes(texts, part)
    assert lengths.tolist() == [len(w) + 1 for w in words]
    tokens = [x for found in words for x in (*found, None)]
    assert {len(x) for x in tokens if x} >= set(range(1, 20))
    assert hashes.tolist() == [int(END) if x is None else hash_word(x) for x in tokens]
    assert [len(x) for x in token_hashes([])] == [0, 0]


@pytest.mark.parametrize("settings", [{}, {"most_tokens": 30}, {"bits": 10}])
def test_scores_against_brute_force(spark, settings):
    rng = random.Random(4)
    texts = {i: english(rng, rng.randint(0, 80)) for i in range(120)} | {200: None, 201: "", 202: "THE Bating É é zzz zzz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    training = docs.where("doc_id < 100")
    got = {r.doc_id: r for r in bloom_model.score(docs, bloom_model.fit(training, **settings)).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), b" "] for k, t in texts.items()}
    count = Counter(x for k in range(100) for x in tokens[k])
    total, different = sum(count.values()), len(count)
    for k, found in tokens.items():
        want = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (different + 1))) for x in found)
        assert math.isclose(got[k].base_score, want, abs_tol=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(found), sum(count[x] > 0 for x in found), total)
        assert got[k].score <= 0


@pytest.mark.parametrize("settings", [{}, {"bits": 16}, {"bits": 9}, {"most_tokens": 30}, {"most_tokens": 0}])
def test_pair_scores_are_those_of_brute_force(spark, settings):
    rng = random.Random(11)
    texts = {i: english(rng, rng.randint(0, 80)) for i in range(120)} | {200: None, 201: "THE Bating zzz zzz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    # with so many probes no pair is taken for another, but for very small blocks, where that can only raise scores
    got = {r.doc_id: r for r in bloom_model.score(docs, bloom_model.fit(docs.where("doc_id < 100"), probes=30, inertia=50.0, **settings)).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), b" "] for k, t in texts.items()}
    count = Counter(x for k in range(100) for x in tokens[k])
    pairs = Counter(p for k in range(100) for p in zip([b" ", *tokens[k]], tokens[k]))
    total, different = sum(count.values()), len(count)
    assert sum(n == 1 for n in pairs.values()) > 1000
    for k, found in tokens.items():
        want = 0.0
        for v, w in zip([b" ", *found], found):
            n = pairs[v, w]
            seen = min(max(1.0, 1.5 * 2 ** math.floor(math.log2(n)) - 0.5), count[v], count[w]) if n else 0.0
            want += math.log10((seen + 50.0 * (count[w] + 0.5) / (total + 0.5 * (different + 1))) / (count[v] + 50.0))
        assert math.isclose(got[k].score, want, abs_tol=1e-9) or settings.get("bits") == 9 and got[k].score > want


def test_smoothing_is_chosen_on_the_training_texts(spark):
    rng = random.Random(21)
    strict = [" ".join(f"{a}{k} {a}{k}x {a}{k}y" for a in rng.choices("abcdefgh", k=60) for k in [rng.randrange(9)]) for _ in range(400)]
    loose = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=200)) for _ in range(400)]
    chosen = []
    for texts in (strict, loose):
        training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
        model = bloom_model.fit(training)
        chosen.append(model.inertia)
        new = spark.createDataFrame([(0, " ".join(texts[0].split()[::-1])), (1, texts[1])], "doc_id long, text string")
        best = {r.doc_id: r.score for r in bloom_model.score(new, model).collect()}
        fixed = {r.doc_id: r.score for r in bloom_model.score(new, bloom_model.fit(training, inertia=model.inertia)).collect()}
        assert best == pytest.approx(fixed)
    assert chosen[0] < chosen[1]  # where the word before tells much, the unigrams weigh less
    assert bloom_model.fit(training.limit(0)).inertia > 0


def test_filter_grows_with_the_pairs(spark):
    texts = [" ".join(f"w{i * 40 + k}" for k in range(40)) for i in range(300)]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    small, large = (bloom_model.fit(training.where(f"doc_id < {n}"), bits=10, inertia=5.0).filter.blocks for n in (30, 300))
    assert 8 * small < large and large > 60


def test_pairs_seen_in_training_score_better(spark):
    rng = random.Random(5)
    text = [f"{a} {a}x {a}y" for a in "abcdefgh"]
    training = spark.createDataFrame([(i, " ".join(rng.choice(text) for _ in range(50))) for i in range(60)], "doc_id long, text string")
    ordered, mixed = " ".join(text), " ".join(sorted(" ".join(text).split(), key=lambda w: w[::-1]))
    model = bloom_model.fit(training, inertia=10.0)
    got = {r.doc_id: r for r in bloom_model.score(spark.createDataFrame([(1, ordered), (2, mixed)], "doc_id long, text string"), model).collect()}
    assert got[1].score > got[1].base_score + 5 and got[1].score > got[2].score + 5
    none = bloom_model.score(training.limit(0), bloom_model.fit(training.limit(0))).collect()
    assert none == []


def test_resampling_finds_what_the_target_lacks(spark):
    rng = random.Random(6)
    texts = {i: english(rng, 80) for i in range(600)}
    for i in range(0, 600, 6):
        texts[i] = " ".join(w if rng.random() < 0.8 else rng.choice(["vile", "foul"]) for w in texts[i].split())
    labels = [(i, 1, 1 if i % 6 == 0 else 0) for i in range(0, 600, 2)] + [(None, 1, 0), (3, None, None)]
    docs = spark.createDataFrame([*texts.items(), (700, None), (701, ""), (None, "the of and"), (5, texts[5])], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = resampling.resample(docs.repartition(3), labels).collect()
    kept = Counter(r.doc_id for r in got if r.kept)
    assert len(got) == 604 and sum(kept[i] for i in range(0, 600, 6)) <= 5
    assert sum(bool(kept[i]) for i in range(600) if i % 6) > 0.9 * 500
    assert not kept[700] and not kept[701] and kept[5] in (0, 2)
    cut = min(r.sample_key for r in got if r.kept)
    assert all(r.kept == (r.sample_key is not None and r.sample_key >= cut) for r in got)
    assert all(r.kept for r in resampling.resample(docs, labels.limit(0)).collect())
    assert resampling.resample(docs.limit(0), labels).collect() == []


def test_few_toxic_words_in_long_texts_are_rejected(spark):
    rng = random.Random(13)
    texts = {i: english(rng, 300) for i in range(900)}
    for i in range(0, 900, 9):
        words = texts[i].split()
        for at in rng.sample(range(300), 4):
            words[at] = rng.choice(["vile", "foul", "putrid"])
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([*texts.items(), (1000, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in resampling.resample(docs, labels).collect()}
    assert sum(kept[i] for i in range(0, 900, 9)) <= 2 and not kept[1000]
    assert sum(kept[i] for i in range(900) if i % 9) > 0.9 * 800
    # without target text all but the rejected ones are kept
    kept = {r.doc_id: r.kept for r in resampling.resample(docs, labels.withColumn("quality", F.lit(0))).collect()}
    assert sum(kept[i] for i in range(0, 900, 9)) <= 2 and kept[1000] and sum(kept[i] for i in range(900) if i % 9) > 0.95 * 800
    assert all(r.kept for r in resampling.resample(docs, labels.where("quality = 0 OR toxic = 0").withColumn("quality", F.lit(0))).collect())


@pytest.mark.parametrize("k", [1, 2, 7, 100])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.randint(-(2**46), 2**46), 5, -7]) for _ in range(100)]
    assert resampling._kth_largest(spark.createDataFrame([(v,) for v in values], "key long"), k) == sorted(values, reverse=True)[k - 1]


def test_weights_keys_and_k_are_those_of_brute_force(spark):
    rng, slots, priors, passage, lose, seed = random.Random(33), 1 << 12, (2.0, 3.0), 512, 0.1, 7
    texts = {i: english(rng, rng.randint(1, 120)) for i in range(300)} | {400: None, 401: ""}
    for i in range(0, 300, 4):
        texts[i] += " raw noise words that good rows lack" * rng.randint(1, 4)
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 240, 2)]
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string").repartition(3)
    got = resampling.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), slots=slots, priors=priors, lose=lose, seed=seed).collect()

    marked = docs.selectExpr("doc_id", "text", f"pmod(xxhash64(doc_id, {seed + 1}), 3) <> 0 AS train", f"shiftrightunsigned(xxhash64({seed}, doc_id, coalesce(text, '')), 11) AS noise")
    rows = [(r.doc_id, (r.text or "").encode().lower().split(), r.train, r.noise) for r in marked.collect()]
    places = [resampling._places(np.array([hash_word(w) for w in words], dtype=np.uint64), 2, slots).tolist() if words else [] for _, words, *_ in rows]
    good = {i for i, quality, _ in labels if quality}
    raw, target = Counter(), Counter()
    for (i, _, train, _), at in zip(rows, places):
        raw.update(at)
        if i in good and train:
            target.update(at)
    size = [sum(n for s, n in target.items() if s // slots == o) / sum(n for s, n in raw.items() if s // slots == o) for o in (0, 1)]
    ratio = {s: math.log((target[s] + priors[s // slots]) / (n * size[s // slots] + priors[s // slots])) for s, n in raw.items()}
    weights, keys = [], []
    for (i, _, _, noise), at in zip(rows, places):
        weights.append(passage * sum(ratio[s] for s in at) / len(at) if at else None)
        gumbel = -math.log(-math.log((noise + 0.5) / 2.0**53))
        keys.append(None if weights[-1] is None else round((weights[-1] + gumbel) * 2**20))
    held = sorted(w for (i, _, train, _), w in zip(rows, weights) if i in good and not train and w is not None)
    place = lose * (len(held) - 1)
    bound = held[int(place)] + (place - int(place)) * (held[min(int(place) + 1, len(held) - 1)] - held[int(place)])
    k = sum(w is not None and w >= bound for w in weights)
    least = sorted((x for x in keys if x is not None), reverse=True)[k - 1]
    # slot weights are single precision, so keys may differ by a few steps
    want = {i: (w, x, x is not None and x >= least) for (i, *_), w, x in zip(rows, weights, keys)}
    for r in got:
        weight, key, kept = want[r.doc_id]
        assert (r.log_weight is None) == (weight is None)
        if weight is not None:
            assert r.log_weight == pytest.approx(weight, abs=1e-3) and abs(r.sample_key - key) < 2000
            assert r.kept == kept or abs(key - least) < 2000
        else:
            assert not r.kept
    assert 0 < k < len(rows) and abs(sum(r.kept for r in got) - k) <= 2


def test_references_are_fitted_and_limits_calibrated(spark):
    rng = random.Random(41)
    tongue = {"aa": [f"k{i}" for i in range(30)], "bb": [f"z{i}o" for i in range(30)]}

    def prose(lang, n):
        words = rng.choices(tongue[lang], [1 / k for k in range(1, 31)], k=n // 2) + [f"w{rng.randrange(10**6)}" for _ in range(n // 2)]
        rng.shuffle(words)
        return ", ".join(words).capitalize() + "."

    rows = [(i, prose("ab"[i % 2] * 2, rng.randint(60, 200)), "ab"[i % 2] * 2) for i in range(400)]
    junk = [(1000 + i, " | ".join(f"QX{rng.randrange(10**6)}" for _ in range(100)), "aa") for i in range(40)]
    odd = [(2000, None, "aa"), (None, "k1 k2", "aa"), (2001, "k1", None), (5, rows[5][1], "bb")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in [*rows, *junk, *odd]], "doc_id long, text string, lang string, kept double, rules string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)] + [(1000 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    refs = fit(docs, labels, common=5)

    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    held = {i for i in range(0, 400, 2) if md5(i) < "8"}
    used = [(t, lang) for i, t, lang in [*rows, *junk, *odd] if i is not None and lang and i not in held and not 1000 <= i < 1030 and i != 1]
    for lang in ("aa", "bb"):
        texts = [t or "" for t, own in used if own == lang]
        words = Counter(w for t in texts for w in re.sub(r"[.,;:?'\"()-]", "", t.lower()).split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert refs.words[lang] == pytest.approx({w: n / sum(words.values()) for w, n in top}) and list(refs.words[lang]) == [w for w, _ in top]
        classes = [0] * 6
        for c in "".join(texts):
            classes[3 if c == " " else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in ".,;:?'\"()-" else 5] += 1
        assert refs.characters[lang] == pytest.approx([n / sum(classes) for n in classes])
    judged = {r.doc_id: r for r in quality_rules(docs, references=refs).collect() if r.doc_id is not None}
    assert not any(judged[i].kept for i in range(1000, 1040)) and sum(judged[i].kept for i in range(400)) > 0.95 * 400
    assert quality_rules(docs, references=refs).columns.count("kept") == 1 and judged[2000].n_words == 0
    far = sorted(judged[i].word_distance for i in held)
    place = 0.99 * (len(far) - 1)
    limit = far[int(place)] + (place - int(place)) * (far[min(int(place) + 1, len(far) - 1)] - far[int(place)])
    assert refs.max_word_distance == pytest.approx(limit, abs=1.1e-4) and refs.max_word_distance >= limit - 1e-9
    none = fit(docs.limit(0), labels)
    assert none.words == {} and none.max_char_distance == math.inf
    assert quality_rules(docs, references=none).where("char_distance IS NOT NULL OR word_distance IS NOT NULL").count() == 0


def test_references_and_limits_come_from_all_rows(spark):
    rng = random.Random(51)
    rows = [(i, " ".join(rng.choices([f"k{j}" for j in range(9)], [1 / j for j in range(1, 10)], k=12)).upper()[: 20 + i % 17], "aa") for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 7000, 3)] + [(i, 1, 0) for i in range(1, 7000, 3)], "doc_id long, quality int, toxic int")
    refs = fit(docs, labels, common=4, char_guard=1, word_guard=1)
    held = {i for i in range(7000) if i % 3 < 2 and hashlib.md5(str(i).encode()).hexdigest() < "8"}
    assert len(held) > 2200 and 7000 - len(held) > 2200
    words = Counter(w for i, t, _ in rows if i not in held for w in t.lower().split())
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert refs.words["aa"] == {w: n / sum(words.values()) for w, n in top}
    judged = quality_rules(docs.where(F.col("doc_id").isin(*held)), references=refs, char_guard=1, word_guard=1)
    for limit, column in ((refs.max_char_distance, "char_distance"), (refs.max_word_distance, "word_distance")):
        assert limit == math.ceil(judged.agg(F.percentile(column, F.lit(0.99))).first()[0] * 10_000) / 10_000


def test_percentile_is_that_of_spark(spark):
    rng = random.Random(52)
    for n, values in ((1, [0.25]), (7, [0.1, 0.3]), (500, None), (501, [0.123456, 0.123457, 0.9])):
        rows = spark.createDataFrame([(rng.choice(values) if values else rng.random() ** 9,) for _ in range(n)] + [(None,)], "far double").repartition(2)
        for share in (0.0, 0.37, 0.99, 1.0):
            assert _percentile(rows, "far", share) == rows.agg(F.percentile("far", F.lit(share))).first()[0]
    assert _percentile(rows.limit(0), "far", 0.99) is None


@pytest.mark.parametrize("most_tokens", [1 << 20, 5, 0])
def test_smoothing_is_that_of_all_pairs(spark, most_tokens):
    rng = random.Random(61)
    texts = [" ".join(f"{a}{k} {a}{k}x" for a in rng.choices("abcd", k=20) for k in [rng.randrange(12)]) + f" {i}" for i in range(60)]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = [[*t.split(), " "] for t in texts]
    count = Counter(x for found in tokens for x in found)
    pairs = Counter(p for found in tokens for p in zip([" ", *found], found))
    total, different = sum(count.values()), len(count)

    def log(inertia):
        each = 0.0
        for (v, w), n in pairs.items():
            seen = min(max(1.0, 1.5 * 2 ** math.floor(math.log2(n)) - 0.5), count[v], count[w]) - 1
            each += n * math.log10((seen + inertia * (count[w] + 0.5) / (total + 0.5 * (different + 1))) / (count[v] - 1 + inertia))
        return each

    want = max(bloom_model._INERTIAS, key=log)
    assert 2.0 < want < 2000.0
    assert bloom_model.fit(training, most_tokens=most_tokens, probes=30).inertia == want
