"""Substring dedup by distributed prefix doubling over sampled positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.hashed_words import mixed
from jobtide.llm.rolling import lowest, names
from jobtide.llm.spans import keyed, without_spans
from jobtide.sources.shared import discard, let_go, written

#: Bytes ranked first, and the longest names that doubling makes; two of these name any string up to twice as long.
_SEED, _LONG = 32, 256
#: Starts of a part of a run: one more than the bytes, eight, by which a string is longer than what all of them share.
_FEW = 9
#: Starts worked on at once.
_PART = 1 << 20


def anchors(data: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Sampled positions (place, first start, last start) of a text: of each ``length``-byte string the place in it where the name
    of _SEED bytes is lowest. Strings that are equal have it at the same offset, wherever they stand."""
    out: list[tuple[int, int, int]] = []
    width = length - _SEED + 1
    for begin in range(0, len(data) - length + 1, _PART):
        part = data[begin : begin + _PART + length - 1]
        place = lowest(names(part, _SEED), width) + begin
        change = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(change[1:], len(place)) - 1
        found = list(zip(place[change].tolist(), (change + begin).tolist(), (last + begin).tolist()))
        if out and found[0][0] == out[-1][0]:
            found[0] = (found[0][0], out.pop()[1], found[0][2])
        out += found
    return out


class _Names:
    """Names of strings of 256 to 512 bytes of a text."""

    def __init__(self, data: np.ndarray):
        self._data, self._begin, self._names = data, 0, None

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        for begin in range(0, len(self._data), _PART):
            inside = (start >= begin) & (start < begin + _PART)
            if inside.any():
                if self._names is None or self._begin != begin:
                    self._begin, self._names = begin, names(self._data[begin : begin + _PART + 2 * _LONG], _LONG)
                at, size = start[inside] - begin, length[inside]
                out[inside] = mixed(self._names[at], self._names[at + size - _LONG]) ^ size.astype(np.uint64)
        return out


def repeated_spans(rows: DataFrame, length: int = 400, width: int = 74) -> DataFrame:
    """Spans (doc, sig, start, stop) that cover all bytes of the ``length``-byte strings that start at two or more places of all texts.

    Names of strings are 64-bit ranks, each made from the pair of names of its halves (prefix doubling). Spark groups sampled positions
    by rank and drops those that are alone, at growing lengths: first that of the seed; then, for each run of ``width`` starts that
    belong to a position, that of the bytes all of them share. Where the run with all its bytes occurs twice, all its strings are repeated. What is
    left is where repeats begin or end; there one run for each different text is cut into parts of nine starts, which are treated likewise; of the parts left, one for each different
    text gives its single strings, and those met twice are repeated. Equal names of over 300 bytes with equal shared bytes (128 bits) are taken for equal strings; single strings of a
    part compare by the name of what all of them share and the other eight bytes themselves.

    ``length`` + ``width`` up to 512, ``length`` - ``width`` from 256 on. No group is ever held by a task: all steps are counts, minima and joins.
    """
    last = length - _SEED  # the largest offset of a sampled position in its string

    def sampling(batches):
        for batch in batches:
            doc, sig, lengths, parts, seeds = batch.column("doc").to_numpy(), batch.column("sig").to_numpy(), [], [], []
            for text in batch.column("text"):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                found = anchors(data, length)
                lengths.append(len(found))
                if found:
                    table = np.array(found, dtype=np.int64)
                    parts.append(table)
                    seeds.append(_seeds(data, table[:, 0]))
            table = np.concatenate([np.zeros((0, 3), dtype=np.int64), *parts])
            seed = np.concatenate([np.zeros(0, dtype=np.uint64), *seeds]).view(np.int64)
            columns = [np.repeat(doc, lengths), np.repeat(sig, lengths), _packed(*table.T), seed]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "sig", "place", "seed"])

    def running(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, sig, text, places in zip(*(batch.column(c) for c in ("doc", "sig", "text", "places"))):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                place, low, high = _unpacked(np.array(places.as_py(), dtype=np.int64))
                first, final = (place - high) // width, (place - low) // width
                count = final - first + 1
                each = np.repeat(np.arange(len(place)), count)
                run = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
                near, far = run * width, np.minimum(run * width + width - 1, last)
                # offsets whose string lies in the text
                at = place[each]
                close, wide = np.maximum(near, at + length - len(data)), np.minimum(far, at)
                named = _Names(data)
                core = mixed(named.of(at - near, length - (far - near)), run.astype(np.uint64))
                span = mixed(named.of(at - wide, length + wide - close), close.astype(np.uint64))
                for column, value in zip(out, (np.full(len(at), doc.as_py()), np.full(len(at), sig.as_py()), at - wide, at - close, close - near, core.view(np.int64), span.view(np.int64))):
                    column.append(value)
            columns = [np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "sig", "low", "high", "skip", "core", "span"])

    def parting(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, sig, text, runs in zip(*(batch.column(c) for c in ("doc", "sig", "text", "runs"))):
                data, table = np.frombuffer(text.as_py().encode(), dtype=np.uint8), runs.as_py()
                low, high, skip, core = (np.array([x[c] for x in table], dtype=np.int64) for c in ("low", "high", "skip", "core"))
                # parts lie at the same offsets from the first start of a run, whether or not its string lies in the text
                at = high + skip
                first, final = (at - high) // _FEW, (at - low) // _FEW
                count = final - first + 1
                each = np.repeat(np.arange(len(at)), count)
                part = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
                at = at[each] - part * _FEW
                late, soon = np.minimum(high[each], at), np.maximum(low[each], at - _FEW + 1)
                named, size = _Names(data), length - _FEW + 1
                own = mixed(named.of(at, np.full(len(at), size)), mixed(core[each].view(np.uint64), part.astype(np.uint64)))
                span = mixed(named.of(soon, length + late - soon), (at - late).astype(np.uint64))
                before, after = _eight(data, at - _FEW + 1), _eight(data, at + size)
                columns = (np.full(len(at), doc.as_py()), np.full(len(at), sig.as_py()), soon, late, at - late, own.view(np.int64), span.view(np.int64))
                for column, value in zip(out, (*columns, np.stack([before, after], axis=1))):
                    column.append(value)
            shapes = [(0,)] * 7 + [(0, 2)]
            columns = [np.concatenate([np.zeros(shape, dtype=np.int64), *c]) for shape, c in zip(shapes, out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns[:7], *columns[7].T.copy())], ["doc", "sig", "low", "high", "skip", "core", "span", "before", "after"])

    texts = rows.select("doc", "sig", "text")
    sampled = written(texts.mapInArrow(sampling, "doc long, sig long, place long, seed long"), "sampled")
    # written, so that a join with a seed that very many places have can be split
    common = written(sampled.groupBy("seed").count().where("count > 1").select("seed"), "seeds")
    let_go(rows.sparkSession)  # each step shuffles about as much as the texts have; what is done with must not wait
    places = sampled.join(common, "seed", "left_semi").groupBy("doc", "sig").agg(F.collect_set("place").alias("places"))
    runs = texts.join(places, ["doc", "sig"]).mapInArrow(running, "doc long, sig long, low long, high long, skip long, core long, span long")
    runs = written(runs, "runs")
    discard(sampled, common)

    spans = written(_different(runs), "spans")
    let_go(rows.sparkSession)
    covered = written(_covered(runs, spans, length), "covered")
    discard(runs)
    edge = _edges(spans).groupBy("doc", "sig").agg(F.collect_list(F.struct("low", "high", "skip", "core")).alias("runs"))
    # rows equal in id and text are covered already, so one of them will do here
    parts = texts.join(edge, ["doc", "sig"]).mapInArrow(parting, "doc long, sig long, low long, high long, skip long, core long, span long, before long, after long")
    parts = written(parts, "parts")
    discard(spans)

    fewer = written(_different(parts, "before", "after"), "spans")
    let_go(rows.sparkSession)
    inside = written(_covered(parts, fewer, length), "covered")
    discard(parts)
    # a string is the shared bytes with k before them and the rest of eight after them: exact, and short enough for built-in expressions
    each = _edges(fewer).select("*", F.explode(F.sequence("low", "high")).alias("start"))
    k = (F.col("high") + F.col("skip") - F.col("start")).cast("int")
    name = F.when(k == 0, F.col("after")).when(k == 8, F.col("before"))
    name = name.otherwise(F.call_function("shiftleft", "before", 64 - 8 * k).bitwiseOR(F.call_function("shiftrightunsigned", "after", 8 * k)))
    singles = written(each.select("doc", "sig", "start", "core", k.cast("byte").alias("k"), name.alias("name")), "strings")
    discard(fewer)
    again = singles.groupBy("core", "k", "name").count().where("count > 1").drop("count")
    found = singles.join(again, ["core", "k", "name"], "left_semi").select("doc", "sig", "start", (F.col("start") + length).alias("stop"))
    # in a step of its own, so that these joins' shuffle files are gone when the texts move
    found = written(covered.unionByName(inside).unionByName(found), "repeated")
    discard(covered, inside, singles)
    return found


def _different(runs: DataFrame, *more: str) -> DataFrame:
    """Of each text that runs have (core, span) how many there are, and the first of them."""
    return runs.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "sig", "low", "high", "skip", *more)).alias("one"))


def _covered(runs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """All bytes of runs whose whole text occurs twice."""
    twice = runs.join(spans.where("n > 1").select("core", "span"), ["core", "span"], "left_semi")
    return twice.select("doc", "sig", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))


def _edges(spans: DataFrame) -> DataFrame:
    """One run of each different text, where some share their core and not all of them occur twice."""
    edge = spans.groupBy("core").agg(F.count("*").alias("different"), F.min("n").alias("fewest")).where("different > 1 AND fewest = 1")
    return spans.join(edge.select("core"), "core", "left_semi").select("core", "one.*")


def _eight(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first one highest; what lies outside the text is 0."""
    padded = np.concatenate([np.zeros(8, dtype=np.uint8), data, np.zeros(16, dtype=np.uint8)])
    return padded[start[:, None] + np.arange(8, 16)].view(">i8").ravel().astype(np.int64)


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text without the bytes covered by repeated strings of ``length`` bytes: doc_id, kept (binary), n_bytes, spans (removed runs).

    Matches never cross rows; a string may repeat within one, and overlap itself. Strings are judged on the input, and all copies go.
    A null text is empty; repeated rows repeat each other's strings; null ids stay null.
    """
    rows = keyed(docs, id_col, text_col)
    return without_spans(rows, repeated_spans(rows, length))


def _packed(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A sampled position and its first and last start, which lie less than 512 bytes before it, in one number."""
    return place << 18 | (place - low) << 9 | place - high


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = packed >> 18
    return place, place - (packed >> 9 & 511), place - (packed & 511)


def _seeds(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), dtype=np.uint64)
    for begin in range(0, len(data), _PART):
        inside = (places >= begin) & (places < begin + _PART)
        out[inside] = names(data[begin : begin + _PART + _SEED - 1], _SEED)[places[inside] - begin] if inside.any() else 0
    return out
