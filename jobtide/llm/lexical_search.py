"""Ranked lexical search: the best documents of each question by impact vectors in buckets of length."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.items import item_blocks, plain_words
from jobtide.sources.shared import written

#: Vectors of a bucket, and of the longest ones that thresholds are first taken from.
_BUCKET, _HEAD = 2048, 1 << 15
#: Bounds are worked out in doubles; by so much they are raised, so that rounding drops nothing.
_SLACK = 1 + 1e-9


class Questions(NamedTuple):
    """Terms of the items: ``terms`` numbers them from 1 on; ``vectors`` has for each item its terms and how often it has them."""

    item_ids: list
    terms: dict[bytes, int]
    vectors: list[tuple[np.ndarray, np.ndarray]]


def _questions(rows) -> Questions:
    terms: dict[bytes, int] = {}
    vectors = []
    for r in rows:
        found = Counter(terms.setdefault(w, len(terms) + 1) for w in plain_words(r.text))
        vectors.append((np.array(list(found), dtype=np.int64), np.array(list(found.values()), dtype=np.int64)))
    return Questions([r.item_id for r in rows], terms, vectors)


def _counted(docs: DataFrame, block: Questions, kind: str) -> DataFrame:
    """Of each text its number of terms and, of those that the items have, the numbers and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for start, texts in blocks(batch.column("text")):
                lengths, terms, counts = [], [], []
                for text in texts:
                    words = plain_words(text)
                    ids = np.fromiter(map(number, words, repeat(0)), dtype=np.int32, count=len(words))
                    found, times = np.unique(ids[ids > 0], return_counts=True)
                    lengths.append(len(words))
                    terms.append(found)
                    counts.append(times.astype(np.int32))
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array(lengths, pa.int64()), _lists(terms, pa.int32()), _lists(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *parts]), kind))


def _holders(counted: DataFrame, size: int) -> np.ndarray:
    """How many texts hold each term of the items; tasks count before they send."""

    def run(batches):
        held = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size + 1)
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(held[terms], pa.int64())], ["term", "df"])

    out = np.zeros(size + 1, dtype=np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def _impacts(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, kind: str, slope: int, saturation: int) -> DataFrame:
    """Impact vectors (terms, impacts) with their length, longest first: dealt by ranges of length, sorted within each."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        weight = shared.value
        for batch in batches:
            size = pc.list_value_length(batch.column("terms")).to_numpy()
            whose, terms = np.repeat(np.arange(len(size)), size), batch.column("terms").flatten().to_numpy()
            tf, n = batch.column("counts").flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()
            m = 100 - slope + (slope * n * n_docs) // n_terms
            value = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + saturation * m[whose]))
            kept = value > 0
            ends = np.append(0, np.cumsum(np.bincount(whose[kept], minlength=len(size)))).astype(np.int32)
            length = np.sqrt(np.bincount(whose[kept], weights=value[kept].astype(float) ** 2, minlength=len(size)))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[kept])) for x in (terms, value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), *lists], ["doc_id", "length", "terms", "impacts"]).filter(pa.array(length > 0))

    vectors = counted.where(F.size("terms") > 0).mapInArrow(run, f"doc_id {kind}, length double, terms array<int>, impacts array<long>")
    # copies have one length; the second key keeps them from having to share a range
    return vectors.repartitionByRange(F.col("length").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("length").desc())


class _Bucket:
    """Vectors of similar length, by row and by term."""

    def __init__(self, length: np.ndarray, size: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.longest, self.length = float(length.max()), length
        self._ends, self._terms, self._impacts = np.append(0, np.cumsum(size)), terms, impacts
        order = np.argsort(terms, kind="stable")
        self._rows, self._values = np.repeat(np.arange(len(size)), size)[order], impacts[order]
        self._starts = np.searchsorted(terms[order], np.arange(n_terms + 2))
        self.highest = np.zeros(n_terms + 1, dtype=np.int64)  # largest impact of each term
        np.maximum.at(self.highest, terms, impacts)
        self._n_terms = n_terms

    def search(self, terms: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score is ``least`` or more, and above 0, with their scores."""
        most = times * self.highest[terms]
        order = np.argsort(most, kind="stable")
        order = order[most[order] > 0]
        # the weakest terms cannot reach the threshold even together, so a row needs one of the others
        weak = int(np.searchsorted(np.cumsum(most[order]), least, "left"))
        rest, strong = order[:weak], order[weak:]
        score, squares = np.zeros(len(self.length), dtype=np.int64), np.zeros(len(self.length))
        for k in strong.tolist():
            part = slice(self._starts[terms[k]], self._starts[terms[k] + 1])
            score[self._rows[part]] += times[k] * self._values[part]
            squares[self._rows[part]] += self._values[part].astype(float) ** 2
        rows = np.flatnonzero(score)
        if not len(rest) or not len(rows):
            rows = rows[score[rows] >= least]
            return rows, score[rows]
        # what the weak terms can add: their largest impacts, or by Cauchy and Schwarz what is left of the row's length
        left = np.sqrt(np.maximum(self.length[rows] ** 2 * _SLACK - squares[rows], 0)) * math.sqrt(float((times[rest] ** 2).sum()))
        rows = rows[score[rows] + np.minimum(left, float(most[rest].sum())) * _SLACK >= least]
        exact = self._exact(rows, terms, times)
        return rows[exact >= least], exact[exact >= least]

    def _exact(self, rows: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        asked = np.zeros(self._n_terms + 1, dtype=np.int64)
        asked[terms] = times
        size = self._ends[rows + 1] - self._ends[rows]
        at = np.repeat(self._ends[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.add.reduceat(asked[self._terms[at]] * self._impacts[at], np.cumsum(size) - size) if len(rows) else np.zeros(0, dtype=np.int64)


def _best(vectors: DataFrame, block: Questions, k: int, least: list[int], kind: str, item_kind: str, bucket: int) -> DataFrame:
    """The ``k`` best rows of each item in each task, as far as they score ``least`` or more: item, item_id, doc_id, score."""
    shared = vectors.sparkSession.sparkContext.broadcast((block.item_ids, block.vectors, len(block.terms), least))

    def run(batches):
        item_ids, questions, n_terms, least = shared.value
        lengths = np.array([math.sqrt(float((times**2).sum())) for _, times in questions])
        need, top = np.array([max(1, x) for x in least], dtype=np.int64), [[] for _ in questions]
        for batch in (part for whole in batches for part in _parts(whole, bucket)):
            size = pc.list_value_length(batch.column("terms")).to_numpy()
            columns = (batch.column(c).flatten().to_numpy() for c in ("terms", "impacts"))
            vectors = _Bucket(batch.column("length").to_numpy(), size, *columns, n_terms)
            ids = batch.column("doc_id")
            # buckets too short for an item's threshold are passed over whole
            for q in np.flatnonzero(lengths * vectors.longest * _SLACK >= need).tolist():
                rows, scores = vectors.search(*questions[q], int(need[q]))
                if len(rows):
                    found = zip((-scores).tolist(), ids.take(pa.array(rows)).to_pylist())
                    top[q] = sorted([*top[q], *((s, d is not None, d) for s, d in found)])[:k]
                    if len(top[q]) == k:
                        need[q] = max(need[q], -top[q][-1][0])
        flat = [(q, item_ids[q], d, -s) for q, rows in enumerate(top) for s, _, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), types)] if flat else [pa.array([], t) for t in types], names)

    names, schema = ["item", "item_id", "doc_id", "score"], f"item long, item_id {item_kind}, doc_id {kind}, score long"
    empty = vectors.sparkSession.createDataFrame([], schema)
    types = [x.type for x in empty.toArrow().schema]
    return vectors.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, most: int):
    return (batch.slice(i, most) for i in range(0, batch.num_rows, most))


def _ranked(found: DataFrame, k: int, *parts: Column) -> DataFrame:
    order = Window.partitionBy("item", *parts).orderBy(F.col("score").desc(), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, block: Questions, k: int, item_kind: str, slope: int, saturation: int, bucket: int, head: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = written(_counted(docs, block, kind), "terms")
    totals = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    held = _holders(counted, len(block.terms))
    weights = np.array([math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * df + 1))) if df else 0 for df in held.tolist()], dtype=np.int64)
    vectors = written(_impacts(counted, weights, totals.docs, totals.terms or 1, kind, slope, saturation), "impacts")
    # the longest vectors give each item a threshold that at least k rows reach
    cut = vectors.approxQuantile("length", [max(0.0, 1 - head / max(1, totals.docs))], 0.001) or [0.0]
    first = _best(vectors.where(F.col("length") >= cut[0]), block, k, [1] * len(block.vectors), kind, item_kind, bucket)
    reached = _ranked(_ranked(first, k, F.pmod(F.xxhash64("doc_id"), F.lit(64))), k).where(F.col("rank") == k).select("item", "score").collect()  # a row an item
    least = [1] * len(block.vectors)
    for r in reached:
        least[r.item] = r.score
    found = _best(vectors, block, k, least, kind, item_kind, bucket)
    return _ranked(_ranked(found, k, F.pmod(F.xxhash64("doc_id"), F.lit(64))), k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    slope: int = 25,
    saturation: int = 12,
    bucket: int = _BUCKET,
    head: int = _HEAD,
    most_bytes: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score (above 0), equal scores by id, null ids first.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its impact in a text that times 10^9 tf div (1000 tf + ``saturation`` m), with m = 100 - ``slope`` + ``slope`` n N div L; a score
    sums impacts over the item's terms, repeats included. All in whole numbers.

    Texts become vectors of impacts once, of the items' terms alone, dealt and sorted by length. The longest ``head`` ones give thresholds. Then each task goes through its vectors in
    buckets: one whose longest vector times the item's length stays below the threshold is passed over, inside the others bounds on what
    single terms can add leave few rows, and these are scored in whole. Nothing is cut off that could be among the best.

    Items are broadcast in blocks of ``most_bytes`` of text, each with passes of its own. Null texts have no terms, null items no answers; each row of items is
    a question and each row of docs a document, also where they repeat.
    """
    rows = texts_of(docs, id_col, text_col)
    item_kind = items.schema[item_col].dataType.simpleString()
    made = [_searched(rows, _questions(b), k, item_kind, slope, saturation, bucket, head) for b in item_blocks(items, item_col, item_text_col, most_bytes)]
    return reduce(DataFrame.unionByName, made).select("item_id", "rank", "doc_id", "score")
