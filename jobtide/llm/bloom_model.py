"""Language-model scores from a log-frequency Bloom filter."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.hashed_words import END, mixed, token_hashes
from jobtide.sources.shared import written

_SECOND = np.uint64(0xD6E8FEB86659FD93)
_RARE = pa.struct([("token", pa.int64()), ("other", pa.int64()), ("known", pa.int64()), ("last", pa.bool_()), ("level", pa.int8()), ("times", pa.int64())])
_RARE_TYPE = "array<struct<token: long, other: long, known: long, last: boolean, level: byte, times: long>>"
#: Weights of the unigrams that fitting tries.
_INERTIAS = (2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0)


class BloomModel(NamedTuple):
    """What scoring needs of the training text.

    ``head``: hashes, sorted, and counts of the most frequent tokens, at most ``most_tokens``, which tasks get as a broadcast. ``counts``: a table
    (token, n) of all tokens. ``filter``: the Bloom filter, ``blocks`` blocks of 2^``bits`` bits, as many as the training pairs need.
    """

    head: Broadcast
    counts: DataFrame
    tokens: int
    different: int
    filter: Filter
    inertia: float


class Filter(NamedTuple):
    """A filter that lies as a file ``name`` beside every executor. Tasks map it into memory, so that its pages are shared and can give way: a task's own memory does not grow with it."""

    name: str
    blocks: int
    bits: int
    probes: int

    def table(self) -> np.ndarray:
        return _mapped(SparkFiles.get(self.name))


@lru_cache(1)
def _mapped(path: str) -> np.ndarray:
    return np.memmap(path, dtype=np.uint64, mode="r")


def fit(
    training: DataFrame,
    most_tokens: int = 1 << 20,
    bits: int = 20,
    probes: int = 4,
    inertia: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> BloomModel:
    """Count the tokens of all training texts and put their pair counts into a Bloom filter.

    Tokens are words in small letters (A-Z only) and an end after each text. All pairs of neighbours count. A pair seen n times enters the filter at levels 1 to
    1 + floor(log2 n), ``probes`` bits each, in one block of 2^``bits`` bits. The filter has as many blocks as keep half of the bits empty, so it grows with the pairs and none
    stays out. It is sent to every executor as a file, once.

    Without ``inertia`` it is the one of a few that gives all pairs of all training texts the highest probability, each pair being left out of the counts for its own turn.
    """
    spark = training.sparkSession
    rows = texts_of(training, id_col, text_col).select("text")
    counted = rows.mapInArrow(_counts, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "counts")
    counts = counted.where("NOT pair").select(F.col("key").alias("token"), "n")
    total = counts.agg(F.sum("n"), F.count("n")).first()
    # how many tokens have each count, in steps of 1 % above 200, so that there are few steps
    step = F.when(F.col("n") <= 200, F.col("n")).otherwise(F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(1.01))) - 532 + 200)
    steps = sorted(counts.groupBy(step.cast("long").alias("s")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["s"])
    least = _fitting([(r["s"], r["c"]) for r in steps], most_tokens)
    head = counts.where(step >= least).toArrow()  # at most most_tokens rows
    found = np.ascontiguousarray(head.column("token").to_numpy()).view(np.uint64)
    order = np.argsort(found)
    known, often = found[order], head.column("n").to_numpy()[order]
    sent = spark.sparkContext.broadcast((known, often))

    pairs = counted.where("pair").select(F.col("key").alias("pair"), _level(F.col("n")).cast("byte").alias("level"))
    entries = pairs.agg(F.sum("level")).first()[0] or 0
    blocks = max(1, math.ceil(entries * probes / (np.log(2) * (1 << bits))))
    made = pairs.withColumn("block", F.shiftrightunsigned("pair", 1) % blocks).groupBy("block").applyInArrow(_table(bits, probes), "block long, bits binary")
    model = BloomModel(sent, counts, total[0] or 0, total[1], _shipped(spark, written(made, "filter"), blocks, bits, probes), inertia or _INERTIAS[-1])
    return model if inertia else model._replace(inertia=_chosen(rows, model))


def _shipped(spark: SparkSession, made: DataFrame, blocks: int, bits: int, probes: int) -> Filter:
    """Put the blocks into one file, one after another as they come to the driver, and have it sent to all executors, also to those that start later."""
    name, size = f"pairs-{uuid.uuid4().hex}", 1 << bits - 3
    path = Path(tempfile.mkdtemp(prefix="jobtide-filter-"), name)
    with path.open("wb") as file:
        file.truncate(blocks * size)
        for row in made.toLocalIterator():
            file.seek(row["block"] * size)
            file.write(row["bits"])
    spark.sparkContext.addFile(str(path))
    return Filter(name, blocks, bits, probes)


def _chosen(rows: DataFrame, model: BloomModel) -> float:
    """The inertia of _INERTIAS under which the pairs of training texts are most probable, each left out of the counts once; the lowest of equal ones.

    A pair's probability is (seen - 1 + inertia * P(w)) / (c(v) - 1 + inertia). Were no pair seen again, the sum of logs would follow from the counts of tokens alone, as each comes first in
    as many pairs as it has occurrences; to that come log(1 + (seen - 1) / (inertia * P(w))) of the pairs that the filter has seen twice or more, in one pass over the texts.
    """
    head, filter_, lowest = model.head, model.filter, float(model.tokens + 0.5 * (model.different + 1))

    def run(batches):
        look_up = _look_up(head.value)
        end = look_up(np.array([END]))
        for batch in batches:
            for _, texts in blocks(batch.column("text"), 2 << 20):
                before, after = _neighbours(*_tokens(texts, look_up), end)
                pairs = _pair(before[:, 0], after[:, 0])
                level = _levels(filter_, pairs, 2)
                again = np.flatnonzero(level > 1)
                before, after, pairs, level = before[again], after[again], pairs[again], level[again]
                count, earlier = _often(head.value[1], after[:, 1]), _often(head.value[1], before[:, 1])
                whole = (before[:, 1] >= 0) & (after[:, 1] >= 0)
                odds = np.maximum(_seen(level[whole], earlier[whole], count[whole]) - 1, 0) * lowest / (count[whole] + 0.5)
                gains = pa.array([[float(np.log1p(odds / x).sum() / np.log(10)) for x in _INERTIAS]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([gains, _rare(before, after, earlier, count, pairs, level, np.array([len(again)]))], ["gains", "rare"])

    found = written(rows.mapInArrow(run, f"gains array<double>, rare {_RARE_TYPE}"), "smoothing")
    n = F.col("n").cast("double")
    plain = [F.sum(n * (F.log10(x * (n + 0.5) / F.lit(lowest)) - F.log10(n - 1 + x))) for x in _INERTIAS]
    rare = _with_counts(found.select(F.lit(0).alias("row"), F.explode("rare").alias("r")).select("row", "r.*"), model.counts)
    odds = F.greatest(F.lit(0.0), _seen_of(F.col("level"), F.col("v"), F.col("w")) - 1) * F.lit(lowest) / (F.col("w") + 0.5)
    parts = [
        model.counts.agg(*plain),
        found.agg(*[F.sum(F.col("gains")[i]) for i in range(len(_INERTIAS))]),
        rare.agg(*[F.sum(F.col("times") * F.log10(1 + odds / x)) for x in _INERTIAS]),
    ]
    sums = [sum(x or 0.0 for x in each) for each in zip(*[part.first() for part in parts])]
    return max(zip(sums, _INERTIAS), key=lambda x: (x[0], -x[1]))[1] if model.tokens else _INERTIAS[-1]


def score(docs: DataFrame, model: BloomModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text; log10 probabilities.

    base_score: sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))) with exact counts. score: the pair model, P(w | v) =
    (n(v w) + inertia * P(w)) / (c(v) + inertia), where n(v w) is the middle of the highest level for which all probes of the
    filter up to it succeed, at most c(v) and c(w), and P(w) is as in base_score; P(w) alone after a token that was never seen.

    Pairs with a token outside the broadcast are looked up in the filter and joined with the table of counts, so that all have exact counts. A null or empty text is its end alone; repeated rows get equal
    scores; a null id stays null. Without any training text V and N are 0, and every probability 1.
    """
    rows = texts_of(docs, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(
        _scoring(model),
        f"doc_id {key}, row long, n_tokens long, n_known long, base double, score double, "
        f"rare {_RARE_TYPE}",
    )
    parts = written(parts, "scores")
    rare = _with_counts(parts.select("row", F.explode("rare").alias("r")).select("row", "r.*"), model.counts)
    v, w, inertia = F.col("v"), F.col("w"), F.lit(float(model.inertia))
    share = (w + 0.5) / F.lit(float(model.tokens + 0.5 * (model.different + 1)))
    seen = _seen_of(F.col("level"), v, w)
    log = F.log10(F.when(v > 0, (seen + inertia * share) / (v + inertia)).otherwise(share))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("log"),
        F.sum(F.when(F.col("last"), F.col("times") * F.log10(share))).alias("base_log"),
        F.sum(F.when(F.col("last") & (w > 0), F.col("times"))).alias("known"),
    )
    log, base_log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("base_log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return parts.join(rare, "row", "left").select(
        *("doc_id", "n_tokens"),
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + base_log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )


def _with_counts(rare: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with a token outside the head (see ``_rare``), with the counts ``v`` and ``w`` of their tokens."""
    n, known = F.coalesce("n", F.lit(0)), F.col("known")
    one = rare.where("other IS NULL").join(counts, "token", "left")
    one = one.select("row", "last", "level", "times", F.when(F.col("last"), known).otherwise(n).alias("v"), F.when(F.col("last"), n).otherwise(known).alias("w"))
    two = rare.where("other IS NOT NULL").join(counts, "token", "left").select("row", "last", "level", "times", "other", n.alias("w"))
    two = two.join(counts.withColumnRenamed("token", "other"), "other", "left").select("row", "last", "level", "times", n.alias("v"), "w")
    return one.unionByName(two)


def _seen_of(level: Column, v: Column, w: Column) -> Column:
    """As ``_seen``, and 0 of a token that was never seen."""
    middle = F.greatest(F.lit(1.0), 1.5 * F.pow(F.lit(2.0), level - 1) - 0.5)
    return F.when((level > 0) & (w > 0), F.least(middle, v.cast("double"), w.cast("double"))).otherwise(0.0)


def _fitting(parts: list[tuple[int, int]], most: int) -> int:
    """The lowest of the steps, which come from the highest down, for which all down to it add up to ``most`` at most."""
    taken, least = 0, parts[0][0] + 1 if parts else 0
    for step, size in parts:
        taken += size
        if taken > most:
            break
        least = step
    return least


def _level(n):
    return F.floor(F.log2(n.cast("double")) + 1e-9) + 1


def _counts(batches):
    """Counts of tokens and of pairs of neighbours, added up over many texts."""
    end = np.array([END])
    tokens, pairs = _Sums(False), _Sums(True)
    for batch in batches:
        for _, texts in blocks(batch.column("text"), 1 << 20):
            found, lengths = token_hashes(texts)
            yield from tokens.add(found)
            yield from pairs.add(_pair(*_neighbours(found, lengths, end)))
    yield from tokens.rest()
    yield from pairs.rest()


class _Sums:
    """Counts of keys, given out when they get many."""

    def __init__(self, pair: bool, most: int = 2_000_000):
        self._pair, self._most, self._held, self._size = pair, most, [], 0

    def add(self, keys: np.ndarray):
        self._held.append(np.unique(keys, return_counts=True))
        self._size += len(self._held[-1][0])
        if self._size > self._most:
            self._held = [_summed(self._held)]
            self._size = len(self._held[0][0])
            if self._size > self._most // 2:
                yield from self.rest()

    def rest(self):
        if self._held:
            keys, n = _summed(self._held)
            for start in range(0, len(keys), 100_000):
                part = keys[start : start + 100_000].view(np.int64), n[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.repeat(self._pair, len(part[0])), *map(pa.array, part)], ["pair", "key", "n"])
        self._held, self._size = [], 0


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _look_up(head: tuple[np.ndarray, np.ndarray]):
    """Hash and place in the head, -1 for tokens outside, as two columns."""
    known, _ = head

    def run(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        inside = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
        return np.stack([hashes.view(np.int64), np.where(inside, at, -1)], axis=1)

    return run


def _tokens(texts: list[str], look_up) -> tuple[np.ndarray, np.ndarray]:
    """What ``look_up`` gives for all tokens of the texts one after another, each text with its end, and the lengths."""
    hashes, lengths = token_hashes(texts)
    different, place = np.unique(hashes, return_inverse=True)
    return look_up(different)[place], lengths


def _neighbours(tokens: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([end, tokens[:-1]])
    before[(np.cumsum(lengths) - lengths)] = end[0]
    return before, tokens


def _often(often: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, often[np.maximum(at, 0)], 0) if len(often) else np.zeros(len(at), dtype=np.int64)


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(np.ascontiguousarray(before).view(np.uint64), np.ascontiguousarray(after).view(np.uint64))


def _steps(pairs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    return mixed(pairs, level), mixed(pairs ^ _SECOND, level) | np.uint64(1)


def _bits(pairs: np.ndarray, level: int, bits: int, probes: int) -> list[np.ndarray]:
    """Places of the bits of a level in their block, one array a probe."""
    first, second = _steps(pairs, level)
    return [(first + np.uint64(i) * second) >> np.uint64(64 - bits) for i in range(probes)]


def _table(bits: int, probes: int):
    def run(group: pa.Table) -> pa.Table:
        pairs, level = group.column("pair").to_numpy().view(np.uint64), group.column("level").to_numpy()
        marks = np.zeros(1 << bits, dtype=bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            for at in _bits(pairs[level >= j], j, bits, probes):
                marks[at] = True
        bits_of = np.packbits(marks, bitorder="little").tobytes()
        return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([bits_of], pa.binary())})

    return run


def _levels(model: Filter, pairs: np.ndarray, first: int = 1) -> np.ndarray:
    """The highest level of each pair up to which every probe succeeds; those below ``first`` are known to."""
    block = ((pairs >> np.uint64(1)) % np.uint64(model.blocks)).astype(np.int64)
    return _levels_in(model.table(), block << model.bits - 6, pairs, model.bits, model.probes, first)


def _seen(level: np.ndarray, *most: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, at most those of the pair's tokens."""
    return np.minimum(np.where(level > 0, np.maximum(1.0, 1.5 * 2.0 ** (level - 1) - 0.5), 0.0), np.minimum(*most))


def _levels_in(table: np.ndarray, start: np.ndarray, pairs: np.ndarray, bits: int, probes: int, lowest: int = 1) -> np.ndarray:
    level, open_ = np.full(len(pairs), lowest - 1, dtype=np.int64), np.arange(len(pairs))
    inside, words = np.uint64(64 - bits), np.uint64(64 - bits + 6)
    for j in range(lowest, 64):
        first, second = _steps(pairs, j)
        so_far = None
        for at in range(probes):
            if not len(open_):
                return level
            good = np.take(table, start + (first >> words).view(np.int64)) >> (first >> inside & np.uint64(63)) & np.uint64(1)
            so_far = good if so_far is None else so_far & good
            left = np.count_nonzero(so_far)
            first = first + second
            # copying pays only where many are done with
            if left < (len(open_) if at == probes - 1 else 0.8 * len(open_)):
                keep = np.flatnonzero(so_far)
                open_, pairs, start, first, second, so_far = open_[keep], pairs[keep], start[keep], first[keep], second[keep], None
        level[open_] = j
    return level


def _rare(before, after, earlier, count, pairs, level, lengths) -> pa.ListArray:
    """Pairs of each text with a token outside the head, once with how often: ``token`` is outside, and so is ``other`` unless null; else ``known``
    is the count of the other one. ``last``: ``token`` is the second of the pair."""
    at = np.flatnonzero((before[:, 1] < 0) | (after[:, 1] < 0))
    text = np.repeat(np.arange(len(lengths)), lengths)[at]
    _, one, times = np.unique(mixed(pairs[at], text), return_index=True, return_counts=True)
    order = np.argsort(one)  # texts stay in order
    at, text, times = at[one[order]], text[one[order]], times[order]
    last = after[at, 1] < 0
    two = last & (before[at, 1] < 0)
    columns = [
        pa.array(np.where(last, after[at, 0], before[at, 0])),
        pa.array(before[at, 0], mask=~two),
        pa.array(np.where(last, earlier[at], count[at]), pa.int64(), mask=two),
        pa.array(last),
        pa.array(level[at].astype(np.int8)),
        pa.array(times.astype(np.int64)),
    ]
    offsets = np.searchsorted(text, np.arange(len(lengths) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_RARE)), type=pa.list_(_RARE))


def _scoring(model: BloomModel):
    head, filter_, inertia = model.head, model.filter, model.inertia
    lowest = model.tokens + 0.5 * (model.different + 1)

    def run(batches):
        look_up, often, row = _look_up(head.value), head.value[1], TaskContext.get().partitionId() << 40
        end = look_up(np.array([END]))

        def block(texts: list[str]) -> tuple:
            tokens, lengths = _tokens(texts, look_up)
            before, after = _neighbours(tokens, lengths, end)
            inside, inner = after[:, 1] >= 0, before[:, 1] >= 0
            count, earlier = _often(often, after[:, 1]), _often(often, before[:, 1])
            share = (count + 0.5) / lowest
            base = np.where(inside, np.log10(share), 0.0)
            sure = earlier > 0
            log = np.where(sure, base + np.log10(inertia / (earlier + inertia)), base)
            pairs = _pair(before[:, 0], after[:, 0])
            whole = inside & inner
            looked = np.flatnonzero(~whole | sure & (count > 0))
            level = np.zeros(len(pairs), dtype=np.int64)
            level[looked] = _levels(filter_, pairs[looked])
            both = looked[whole[looked]]
            seen = _seen(level[both], earlier[both], count[both])
            log[both] = np.log10((seen + inertia * share[both]) / (earlier[both] + inertia))
            log[~whole] = 0.0  # these come with the counts that the join brings
            first = np.cumsum(lengths) - lengths
            return (
                lengths,
                np.add.reduceat(inside & (count > 0), first, dtype=np.int64),
                np.add.reduceat(base, first),
                np.add.reduceat(log, first),
                _rare(before, after, earlier, count, pairs, level, lengths),
            )

        for batch in batches:
            columns = list(zip(*[block(texts) for _, texts in blocks(batch.column("text"), 2 << 20)])) or [()] * 5
            n = batch.num_rows
            numbers = [pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            rare = pa.concat_arrays(list(columns[4])) if columns[4] else pa.array([], pa.list_(_RARE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.arange(row, row + n)), *numbers, rare],
                ["doc_id", "row", "n_tokens", "n_known", "base", "score", "rare"],
            )
            row += n

    return run
