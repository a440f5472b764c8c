"""Benchmark decontamination by suffix arrays of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.items import item_blocks, plain_words
from jobtide.sources.shared import ship_package

#: Words of a shard: what one suffix array is built over. Several texts, or a part of a longer one.
_SHARD = 1 << 20


class Suffixes:
    """Test suffixes: every word of every item starts one. Words are numbered from 1 on; 0 stands between items and for any other word."""

    def __init__(self, rows, window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [None if r.item_id is None else str(r.item_id) for r in rows]
        words = [plain_words(r.text) for r in rows]
        flat, item, place, left = [], [], [], []
        for i, found in enumerate(words):
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in found] + [0]
            item += [i] * (len(found) + 1)
            place += range(len(found) + 1)
            left += range(len(found), -1, -1)
        self.words = np.array([*flat, 0], dtype=np.int32)
        self.item, self.place, self.left = (np.array(x, dtype=np.int32) for x in (item, place, left))
        self.starts = np.flatnonzero(self.left > 0)
        self.longest, self.window = int(self.left.max(initial=0)), min(window, int(self.left.max(initial=0)))
        # windows that several items share, or one has twice, are searched once
        length = {i: min(window, len(found)) for i, found in enumerate(words) if found}
        owners: dict[bytes, list] = {}
        for j in self.starts.tolist():
            n = length[item[j]]
            if left[j] >= n:
                owners.setdefault(self.words[j : j + n].tobytes(), [j, n, set()])[2].add(item[j])
        self.windows = np.array([[j, n] for j, n, _ in owners.values()], dtype=np.int64).reshape(-1, 2)
        self.owners = [sorted(s) for *_, s in owners.values()]


class SuffixArray:
    """The suffixes of a shard that start with a word of the test items, in order, up to ``depth`` words deep.

    Built by prefix doubling: places are sorted by the ranks of their next h words and of the h words after these, for h = 1, 2, 4 ...; only
    places that still share a rank are sorted again.
    """

    def __init__(self, words: np.ndarray, depth: int):
        self.words = np.append(words, np.zeros(1, dtype=np.int32))
        place = np.flatnonzero(words)
        sa = place[np.argsort(words[place], kind="stable")]
        rank = np.zeros(len(words) + 1, dtype=np.int64)  # 0: no suffix of the items goes on here
        change = np.append(True, np.diff(words[sa]) != 0)[: len(sa)]
        rank[sa] = np.maximum.accumulate(np.where(change, np.arange(len(sa)), 0)) + 1
        slots, h = _shared(np.arange(len(sa)), change), 1
        while len(slots) and h < depth:
            at = sa[slots]
            key = rank[at] << 32 | rank[np.minimum(at + h, len(words))]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[slots] = at
            change = np.append(True, key[1:] != key[:-1])
            rank[at] = np.maximum.accumulate(np.where(change, slots, 0)) + 1
            slots, h = _shared(slots, change), 2 * h
        self.places = sa

    def _common(self, test: np.ndarray, start: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, up to ``most``, the test suffixes at ``start`` share with those at ``place``."""
        shared, live = np.zeros(len(start), dtype=np.int64), np.arange(len(start))
        while len(live):
            live = live[shared[live] < most[live]]
            a, b = test[start[live] + shared[live]], self.words[place[live] + shared[live]]
            live = live[(a == b) & (a > 0)]
            shared[live] += 1
        return shared

    def search(self, test: np.ndarray, start: np.ndarray, most: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search: how many suffixes come before each test suffix cut to ``most`` words; with ``after``, also those it begins."""
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(self.places), dtype=np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            place, first, limit = self.places[middle], start[open_], most[open_]
            n = self._common(test, first, place, limit)
            ended = n == limit
            less = np.where(ended, after, self.words[place + n] < test[first + np.where(ended, 0, n)])
            low[open_], high[open_] = np.where(less, middle + 1, low[open_]), np.where(less, high[open_], middle)
        return low

    def longest(self, test: np.ndarray, start: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match of each test suffix, and a place that has it: the better of its two neighbours in the order."""
        if not len(self.places):
            return np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        at = self.search(test, start, most)
        near = [self.places[np.clip(at + d, 0, len(self.places) - 1)] for d in (-1, 0)]
        size = [self._common(test, start, p, most) for p in near]
        return np.maximum(*size), np.where(size[0] >= size[1], *near)


class Hits(NamedTuple):
    n_words: int
    spans: list[tuple[int, int]]
    items: set[int]


def _shared(slots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Slots whose rank another slot has as well; ``change`` marks those that differ from the one before."""
    alone = change & np.append(change[1:], True)[: len(change)]
    return slots[~alone]


def _shards(texts: list[str], vocab: dict[bytes, int], overlap: int, most: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Shards of some ``most`` words: numbers of the words, and the texts in it as (number, first word, words started here, place in the shard).

    Texts do not meet in a shard: a 0 stands after each. A text of more words is cut; each part has the next ``overlap`` words as well.
    """
    held, parts, size = [], [], 0
    for number, text in enumerate(texts):
        found = plain_words(text)
        words = np.fromiter(map(vocab.get, found, repeat(0)), dtype=np.int32, count=len(found))
        for first in range(0, max(1, len(words)), most):
            part = words[first : first + most + overlap]
            if parts and size + len(part) > most:
                yield np.concatenate(held), parts
                held, parts, size = [], [], 0
            parts.append((number, first, min(most, len(words) - first), size))
            held += [part, np.zeros(1, dtype=np.int32)]
            size += len(part) + 1
    if parts:
        yield np.concatenate(held), parts


def _hits(texts: list[str], model: Suffixes, most: int) -> list[Hits]:
    """Words of each text that windows cover, and the items these windows are from."""
    total, marks, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    test, (start, length) = model.words, model.windows.T
    for words, parts in _shards(texts, model.vocab, max(0, model.window - 1), most):
        array = SuffixArray(words, model.window)
        reach, _ = array.longest(test, start, length)
        there = np.flatnonzero(reach >= length)  # windows that this shard has
        low, high = (array.search(test, start[there], length[there], after) for after in (False, True))
        places = [array.places[a:b] for a, b in zip(low.tolist(), high.tolist())]
        which = np.repeat(there, [len(p) for p in places])
        place = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        begins = np.array([p[3] for p in parts])
        part = np.searchsorted(begins, place, "right") - 1
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(len(parts) + 1))
        for k, (number, first, own, begin) in enumerate(parts):
            total[number] += own
            mine = order[edge[k] : edge[k + 1]]
            if len(mine):
                at, window = place[mine] - begin + first, which[mine]
                marks[number].append(np.stack([at, at + length[window]], axis=1))
                items[number].update(i for w in np.unique(window).tolist() for i in model.owners[w])
    return [Hits(n, _joined(m), i) for n, m, i in zip(total, marks, items)]


def _joined(marks: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spans of words as maximal ones, in order."""
    if not marks:
        return []
    table = np.concatenate(marks)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    reach = np.maximum.accumulate(table[:, 1])
    new = np.append(True, table[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(table) - 1)
    return list(zip(table[new, 0].tolist(), reach[last].tolist()))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shard: int = _SHARD,
    most_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """What each text shares with the items: doc_id, n_words, spans (start, stop) of words inside windows, items (ids as strings, sorted).

    A window is ``window`` consecutive words of an item, or all of a shorter item. Each task sorts the suffixes of its own texts, a shard of ``shard``
    words at a time, and finds all test suffixes in that array by binary search, so texts are never shuffled and a window that
    very many texts have is a range of each array. Items are broadcast, in blocks of ``most_bytes`` of text, each with a pass of its own.

    Matches never cross texts. Null and empty texts have no words; null and empty items are never found; an item without an id is found
    but not named; items equal in id count once; repeated rows give repeated rows, a null id stays null.
    """
    rows = texts_of(docs, id_col, text_col).withColumns({"doc": F.xxhash64("doc_id"), "sig": F.xxhash64("text")})
    kind = rows.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, doc long, sig long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
    found = [rows.mapInArrow(_searching(docs, block, window, shard), layout) for block in item_blocks(items, item_col, item_text_col, most_bytes)]
    if len(found) == 1:
        return found[0].drop("doc", "sig")
    # rows equal in id and text have equal results, so they may meet; their number is that of each block
    every = reduce(DataFrame.unionByName, found).groupBy("doc", "sig", "doc_id", "n_words")
    every = every.agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"), F.count("*").alias("n"))
    copies = F.explode(F.expr(f"sequence(1L, n div {len(found)})"))
    every = every.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("copy", copies)
    return every.mapInArrow(_joining, layout).drop("doc", "sig")


def _searching(docs: DataFrame, block, window: int, shard: int):
    model = docs.sparkSession.sparkContext.broadcast(Suffixes(block, window))

    def run(batches):
        for batch in batches:
            for start, texts in blocks(batch.column("text")):
                found = _hits(texts, model.value, shard)
                part = batch.slice(start, len(texts))
                names = [sorted({model.value.names[i] for i in h.items} - {None}) for h in found]
                spans = [[{"start": a, "stop": b} for a, b in h.spans] for h in found]
                made = [pa.array([h.n_words for h in found], pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "doc", "sig")), *made], ["doc_id", "doc", "sig", "n_words", "spans", "items"])

    return run


def _joining(batches):
    """Spans of several blocks as maximal ones."""
    for batch in batches:
        tables = [[np.array([[s["start"], s["stop"]] for s in x], dtype=np.int64).reshape(-1, 2)] if x else [] for x in batch.column("spans").to_pylist()]
        spans = pa.array([[{"start": a, "stop": b} for a, b in _joined(t)] for t in tables], _SPANS)
        columns = [spans if c == "spans" else batch.column(c) for c in ("doc_id", "doc", "sig", "n_words", "spans", "items")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "sig", "n_words", "spans", "items"])


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    least: int = 10,
    shard: int = _SHARD,
    most_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The longest verbatim match of every test suffix in all texts, with a place: item_id (string), item_word, length, doc_id, doc_word.

    Only matches of ``least`` words or more. Each shard gives its longest one; they meet by item and word, of equal ones the lowest id and word. Items equal in
    id are compared together.
    """
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def searching(block):
        model = docs.sparkSession.sparkContext.broadcast(Suffixes(block, least))

        def run(batches):
            m = model.value
            for batch in batches:
                ids = batch.column("doc_id")
                for start, texts in blocks(batch.column("text")):
                    for words, parts in _shards(texts, m.vocab, max(0, m.longest - 1), shard):
                        size, place = SuffixArray(words, m.longest).longest(m.words, m.starts, m.left[m.starts].astype(np.int64))
                        kept = np.flatnonzero(size >= least)
                        part = np.searchsorted([p[3] for p in parts], place[kept], "right") - 1
                        first = np.array([p[1] - p[3] for p in parts], dtype=np.int64)
                        whose = pa.array([start + parts[k][0] for k in part.tolist()], pa.int64())
                        at = m.starts[kept]
                        columns = [[m.names[i] for i in m.item[at].tolist()], m.place[at], size[kept], ids.take(whose), place[kept] + first[part]]
                        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), columns[3], pa.array(columns[4], pa.int64())]
                        yield pa.RecordBatch.from_arrays(arrays, ["item_id", "item_word", "length", "doc_id", "doc_word"])

        return rows.mapInArrow(run, f"item_id string, item_word long, length long, doc_id {kind}, doc_word long")

    found = reduce(DataFrame.unionByName, [searching(block) for block in item_blocks(items, item_col, item_text_col, most_bytes)])
    best = found.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_word")).alias("best"))
    return best.select("item_id", "item_word", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_word")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, shard: int = _SHARD, most_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The documents that share no window with the items (see ``contamination``), with all their columns; nulls and repeated rows stay."""
    ship_package(docs.sparkSession)

    def clean(block):
        model = docs.sparkSession.sparkContext.broadcast(Suffixes(block, window))

        def run(batches):
            for batch in batches:
                for start, texts in blocks(batch.column(text_col)):
                    yield batch.slice(start, len(texts)).filter(pa.array([not h.spans for h in _hits(texts, model.value, shard)], pa.bool_()))

        return run

    for block in item_blocks(items, item_col, item_text_col, most_bytes):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


def report(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """Figures of ``contamination``: doc_id, n_words, n_hit (words inside windows), n_items, items_sha256 (of their ids, comma-joined), contaminated."""
    found = contamination(docs, items, **more)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))
