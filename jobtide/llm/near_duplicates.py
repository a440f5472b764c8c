"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.common import SPACES
from jobtide.llm.components import merged
from jobtide.llm.hashed_words import HashedWords, hash_word, mixed
from jobtide.llm.spans import carried, keyed
from jobtide.sources.shared import written

_MANY = 4096


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words, given by their hashes; of all words, if there are fewer."""
    if not len(words):
        return words
    span = min(width, len(words))
    run = words[: len(words) - span + 1]
    for n in range(1, span):
        run = mixed(run, words[n : len(words) - span + 1 + n])
    return np.unique(run)


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of a min-max signature: ``rows`` / 2 permutations a band, each with its smallest and largest value."""
    random = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, (2, bands * rows // 2, 1), dtype=np.uint64)
    low, high = None, None
    for part in np.array_split(found, len(found) // _MANY + 1):
        moved = (part ^ random[0]) * (random[1] * np.uint64(2) + np.uint64(1))
        low = moved.min(axis=1) if low is None else np.minimum(low, moved.min(axis=1))
        high = moved.max(axis=1) if high is None else np.maximum(high, moved.max(axis=1))
    each = np.concatenate([low.reshape(bands, -1), high.reshape(bands, -1)], axis=1)
    key = np.arange(bands, dtype=np.uint64)
    for column in each.T:
        key = mixed(key, column)
    return key


def near_duplicates(
    docs: DataFrame,
    similarity: int = 85,
    width: int = 5,
    bands: int = 48,
    rows: int = 8,
    stars: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of near-duplicates: doc_id, doc, sig, n_shingles, component_id (the lowest id that links reach), kept.

    Two rows are linked when 100 * intersection >= ``similarity`` * union of their sets of ``width``-word shingles (letters A-Z in small).
    Rows with equal sets form a class and count once from there on. Classes that agree in a band of their min-max signature are candidates; with the
    defaults a pair of similarity 0.85 misses all bands with probability 3e-7. First every class is compared with the class that
    most of its buckets have as their star, ``stars`` times with other stars, which joins most groups. Then buckets that still hold several components
    are taken up: classes outside the largest of a bucket are compared, in blocks, with all classes of that component and with each other, so
    that no pair that shares a bucket goes untested, and only links that join components leave a block.

    A text with fewer words is one shingle; one without words (or null) is linked with nothing and is kept. A group without any id has a null
    component_id. Repeated rows are linked, and all rows with the lowest id of their group are kept.
    """
    named = _grouped(docs, similarity, width, bands, rows, stars, id_col, text_col)
    least = named.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "comp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "doc", "sig", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, similarity: int, width: int, bands: int, rows: int, stars: int, id_col: str, text_col: str) -> DataFrame:
    """Rows with a number for their group: doc_id, doc, sig, n_shingles, comp (null without shingles)."""
    named = keyed(docs, id_col, text_col)
    members = named.mapInArrow(_signing(width, bands, rows), _schema(named))
    members = written(members, "members")
    classes = members.where("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"))
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets.join(shared, "bucket").select("bucket", "node", "n"), "buckets")
    nodes = buckets.select("node").distinct()
    texts = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc", "sig")).alias("one"), F.first("n_shingles").alias("size"))
    texts = named.join(texts.select("node", "one.*", "size"), ["doc", "sig"]).dropDuplicates(["node"]).select("node", "text", "size")
    texts = written(texts, "texts")
    labels = written(nodes.select("node", F.col("node").alias("comp")), "labels")

    for turn in range(stars):
        labels = merged(labels, written(_star_links(buckets, labels, texts, turn, similarity, width), "links"))
    labels = merged(labels, written(_block_links(buckets, labels, texts, similarity, width), "links"))

    named = members.select("doc_id", "doc", "sig", "n_shingles", "node").join(labels, "node", "left")
    return named.withColumn("comp", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node"))).drop("node")


def without_copies(
    docs: DataFrame, similarity: int = 85, width: int = 5, bands: int = 48, rows: int = 8, stars: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: that of the lowest id, a null one last, then of the lowest hash of its text. Of rows that repeat each other in
    id and text any may be the one. Texts without words are in no group and stay."""
    groups = _grouped(docs, similarity, width, bands, rows, stars, id_col, text_col).where("n_shingles > 0")
    copies = groups.groupBy("comp", "doc_id", "doc", "sig").agg(F.count("*").alias("copies"))
    first = F.min_by(F.struct("doc", "sig", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "sig"))
    one = copies.groupBy("comp").agg(first.alias("one")).select("one.*")
    named = keyed(docs, id_col, text_col, carry=True).join(one, ["doc", "sig"], "left")
    blank = F.btrim("text", F.lit(SPACES)) == ""
    single = named.where((F.col("copies") == 1) | blank)
    # repeats combine before they move
    several = named.where((F.col("copies") > 1) & ~blank).dropDuplicates(["doc", "sig"])
    text = F.when(~F.col("carried.no_text"), F.col("text"))
    return single.unionByName(several).select(*carried(docs, text_col, text))


def _schema(named: DataFrame) -> str:
    return f"doc_id {named.schema['doc_id'].dataType.simpleString()}, doc long, sig long, n_shingles long, node long, bands array<long>"


def _signing(width: int, bands: int, rows: int):
    def run(batches):
        words = HashedWords(lambda h: h)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for _, texts in words.batches(batch.column("text")):
                for text in texts:
                    found = shingles(text, width)
                    sizes.append(len(found))
                    nodes.append(hash_word(found.tobytes()))
                    keys.append(band_keys(found, bands, rows).view(np.int64) if len(found) else [])
            made = [pa.array(sizes, pa.int64()), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "sig")), *made], ["doc_id", "doc", "sig", "n_shingles", "node", "bands"]
            )

    return run


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components: bucket, node, comp, n."""
    named = buckets.join(labels, "node")
    several = named.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("bucket")
    return named.join(several, "bucket", "left_semi")


def _star_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame, turn: int, similarity: int, width: int) -> DataFrame:
    """Links of each class with the star of most of its open buckets: the class of lowest hash in the bucket."""
    rows = _open(buckets, labels)
    rank = F.xxhash64(F.lit(turn), "node")
    stars = rows.groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), F.col("node").alias("star"), F.col("comp").alias("star_comp"))).alias("s"))
    pairs = rows.join(stars.select("bucket", "s.star", "s.star_comp"), "bucket").where("comp != star_comp")
    pairs = pairs.groupBy("node", "star").agg(F.count("*").alias("votes")).groupBy("node").agg(F.max_by("star", F.struct("votes", "star")).alias("star"))
    other = texts.select(F.col("node").alias("star"), F.col("text").alias("star_text"))
    both = pairs.join(texts.select("node", "text"), "node").join(other, "star").select("node", "star", "text", "star_text")

    def run(batches):
        sets = _Sets(width)
        for batch in batches:
            good = []
            for text, star in zip(batch.column("text"), batch.column("star_text")):
                good.append(_linked(sets.of(text.as_py()), sets.star(star.as_py()), similarity))
            kept = batch.select(["node", "star"]).filter(pa.array(good, pa.bool_()))
            yield kept.rename_columns(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _block_links(
    buckets: DataFrame, labels: DataFrame, texts: DataFrame, similarity: int, width: int, asked: tuple[int, int] = (128, 1 << 18), told: tuple[int, int] = (1024, 1 << 21)
) -> DataFrame:
    """Links between components that share an open bucket: classes outside the bucket's main component, ``asked`` at a time, against that
    component and each other, ``told`` at a time: so many classes, or so many shingles of them, whichever makes the smaller blocks."""
    rows = _open(buckets, labels)
    parts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m")).select("bucket", F.col("m.comp").alias("main"))
    outside = rows.join(main, "bucket").where("comp != main").select("main", "node", "comp").distinct()
    outside = written(outside, "outside")
    inside = labels.withColumn("main", F.col("comp")).join(outside.select("main").distinct(), "main", "left_semi").select("main", "node", "comp")
    asking = F.col("asks")
    each = outside.withColumn("asks", F.lit(True)).unionByName(inside.withColumn("asks", F.lit(False))).join(texts.select("node", "size"), "node")
    sizes = each.groupBy("main").agg(F.count_if(asking).alias("q"), F.sum(F.when(asking, F.col("size"))).alias("qw"), F.count("*").alias("m"), F.sum("size").alias("mw"))
    parts = [F.ceil(F.greatest(F.col(n) / most[0], F.col(w) / most[1])).alias(name) for n, w, most, name in (("q", "qw", asked, "qs"), ("m", "mw", told, "ms"))]
    sizes = sizes.select("main", *parts)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))

    def block(count: str, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))

    queries = outside.join(sizes, "main").withColumn("count", F.col("ms")).select("main", "node", "comp", block("qs", 1).alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    answers = inside.unionByName(outside).join(sizes, "main").withColumn("count", F.col("qs"))
    answers = answers.select("main", "node", "comp", every.alias("i"), block("ms", 2).alias("j"), F.lit(False).alias("asks"))
    work = queries.unionByName(answers).join(texts.select("node", "text"), "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = _Sets(width)
        found = list(zip(frame["node"], frame["comp"], frame["asks"], map(sets.of, frame["text"])))
        return pd.DataFrame(list(_across(found, similarity)), columns=["a", "b"], dtype="int64")

    return work.groupBy("main", "i", "j").applyInPandas(run, "a long, b long")


def _across(found: list[tuple[int, int, bool, np.ndarray]], similarity: int) -> Iterator[tuple[int, int]]:
    """Links of the asking classes with the others that join components not joined yet."""
    asking = [(node, comp, s) for node, comp, asks, s in found if asks]
    if not asking:
        return
    values = np.concatenate([s for *_, s in asking])
    who = np.repeat(np.arange(len(asking)), [len(s) for *_, s in asking])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    sizes = np.array([len(s) for *_, s in asking])
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    for node, comp, asks, own in found:
        if asks:
            continue
        begin, end = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        count = end - begin
        hits = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(who[hits], minlength=len(asking))
        for k in np.flatnonzero(100 * common >= similarity * (sizes + len(own) - common)):
            a, b = top(comp), top(asking[k][1])
            if a != b:
                up[a] = b
                yield node, asking[k][0]


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= similarity * (len(a) + len(b) - common)


class _Sets:
    """Shingle sets of texts; that of a star, which many rows name, is remembered."""

    def __init__(self, width: int):
        self._words, self._width = HashedWords(lambda h: h), width
        self.star = lru_cache(16)(self.of)

    def of(self, text: str) -> np.ndarray:
        return shingles(self._words.of([text])[0], self._width)
