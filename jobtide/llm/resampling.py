"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from jobtide.llm.common import texts_of
from jobtide.llm.hashed_words import HashedWords, mixed
from jobtide.sources.shared import ship_package, written


#: Keys lie between this and its negative.
_LARGEST = float(1 << 46)


class Resampling(NamedTuple):
    """A fitted model. ``weights``: log ratios of each slot, of target to raw text and of toxic to clean rows; ``least``: the smallest key that is
    sampled, None for all; ``worst``: the strongest toxic evidence that is let pass, None for any."""

    weights: Broadcast
    orders: int
    passage: int
    seed: int
    least: int | None
    worst: float | None

    def scored(self, text: Column) -> Column:
        """``weight``, the log ratio of target and raw model's probabilities of a text, for a passage of ``passage`` n-grams of it, and ``evidence``,
        the largest log ratio of toxic to clean rows among its n-grams; null without words."""
        return _scored(self.weights, self.orders, self.passage)(F.coalesce(text, F.lit("")))

    def rejected(self, evidence: Column) -> Column:
        return F.lit(False) if self.worst is None else F.coalesce(evidence > self.worst, F.lit(False))

    def key(self, doc_id: Column, text: Column, log_weight: Column) -> Column:
        """Log weight plus Gumbel noise drawn from id and text, as an integer in the same order (steps of 2^-20). Null weights stay null."""
        noise = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), doc_id, F.coalesce(text, F.lit(""))), 11)
        even = (noise.cast("double") + 0.5) / F.lit(2.0**53)
        steps = F.round((log_weight - F.log(-F.log(even))) * F.lit(2.0**20))
        return F.when(log_weight.isNotNull(), F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), steps)).cast("long"))

    def kept(self, key: Column) -> Column:
        return F.lit(True) if self.least is None else F.coalesce(key >= self.least, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    orders: int = 2,
    slots: int = 1 << 20,
    priors: tuple[float, ...] = (5.0, 100.0),
    passage: int = 512,
    lose: float = 0.03,
    lose_clean: float = 0.01,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Resampling:
    """Fit both models on ``docs`` and find the k rows of largest key.

    Target rows: those that ``labels`` (doc_id, quality, toxic) calls good and not toxic, at most ``sample`` of them, those of lowest
    hash. Two thirds are the target text, the others are held out. Raw text: all rows. Each n-gram (up to ``orders`` words) counts in one of ``slots`` hashed slots an order; the order's one of
    ``priors`` is added to target counts and to raw counts brought to their size, so that rare slots say little.
    k is the number of rows whose log weight is no lower than that of all but a share ``lose`` of the held-out target
    rows, since labels may be wrong. Rows tied with the k-th are sampled as well. Without target rows all rows are.

    A few toxic words hardly move the weight of a long text. So a second ratio compares in how many labelled toxic and clean (toxic 0) rows each slot
    is found, at most ``sample`` of either, two thirds of them; a row is rejected if its strongest n-gram exceeds what all but a share ``lose_clean``
    of the held-out clean rows have. Rejected rows have no key. Without toxic or held-out clean rows none is rejected.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named, toxic = labels.where("doc_id IS NOT NULL"), F.coalesce(F.col("toxic"), F.lit(0))
    bad = named.where(toxic == 1).select("doc_id").distinct()
    kinds = {
        "good": named.where((F.col("quality") == 1) & (toxic == 0)),
        "toxic": bad,
        "clean": named.where("toxic = 0").join(bad, "doc_id", "left_anti"),
    }
    marks = None
    for kind, found in kinds.items():
        found = found.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
        found = found.select("doc_id", *[F.lit(kind == k).alias(k) for k in kinds])
        marks = found if marks is None else marks.unionByName(found)
    marks = marks.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in kinds])
    marks = marks.withColumn("train", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)) != 0)
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(marks), "doc_id", "left")  # at most three times ``sample`` ids
    uses = [F.coalesce(F.col(k) & F.col("train"), F.lit(False)).alias(k) for k in kinds]
    counts = rows.select("text", *uses).mapInArrow(_counting(orders, slots), "slot int, raw long, good long, toxic long, clean long")
    total = written(counts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("raw", *kinds)]), "slots")
    order = F.floor(F.col("slot") / slots)
    sizes = {r.order: r for r in total.groupBy(order.alias("order")).agg(*[F.sum(c).alias(c) for c in ("raw", *kinds)]).collect()}  # a row an order
    targets, toxics = (sum(r[c] for r in sizes.values()) for c in ("good", "toxic"))
    ratios = [_ratio("good", "raw", order, sizes, priors).alias("weight"), _ratio("toxic", "clean", order, sizes, priors).alias("evidence")]
    table = total.select("slot", *[r.cast("float") for r in ratios]).toArrow()  # as many rows as there are slots at most
    weights = np.zeros((2, orders * slots), dtype=np.float32)
    weights[:, table.column("slot").to_numpy()] = table.column(1).to_numpy(), table.column(2).to_numpy()
    del table
    model = Resampling(spark.sparkContext.broadcast(weights), orders, passage, seed, None, None)
    del weights
    if not targets and not toxics:
        return model
    scored = rows.withColumn("scored", model.scored(F.col("text")))
    key = model.key(F.col("doc_id"), F.col("text"), F.col("scored.weight"))
    held_out = [(F.coalesce(F.col(k), F.lit(False)) & ~F.col("train")).alias(k) for k in ("good", "clean")]
    scored = written(scored.select(*held_out, "scored.*", key.alias("key")), "weights")
    # one row from each task, over at most ``sample`` values
    if toxics:
        model = model._replace(worst=scored.where("clean").agg(F.percentile("evidence", F.lit(1 - lose_clean))).first()[0])
    if not targets:
        return model
    scored = scored.where(~model.rejected(F.col("evidence")))
    bound = scored.where("good").agg(F.percentile("weight", F.lit(lose))).first()[0]
    k = scored.where(F.col("weight") >= bound).count() if bound is not None else 0
    return model._replace(least=_kth_largest(scored.select("key").where("key IS NOT NULL"), k) if k else None)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every row of ``docs``; see ``fit`` for how rows are sampled and the settings.

    A text without words has no weight and is not sampled, unless there is no target text; one rejected as toxic has no key and is never kept; null ids
    can be sampled. Repeated rows
    share their noise and so their fate. Needs no shuffle of texts.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **settings)
    return decided(docs, model, id_col, text_col).select(F.col(id_col).alias("doc_id"), "log_weight", "sample_key", "kept")


def decided(docs: DataFrame, model: Resampling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight, sample_key and kept; columns of these names are replaced."""
    made = docs.withColumn("kept", model.scored(F.col(text_col))).withColumn("log_weight", F.col("kept.weight"))
    rejected = model.rejected(F.col("kept.evidence"))
    key = F.when(~rejected, model.key(F.col(id_col), F.col(text_col), F.col("log_weight")))
    return made.withColumn("sample_key", key).withColumn("kept", model.kept(F.col("sample_key")) & ~rejected)


def _ratio(one: str, other: str, order: Column, sizes: dict, priors: tuple[float, ...]) -> Column:
    """Log ratio of two counts of a slot, brought to the same size for its order."""
    out = F.lit(None).cast("double")
    for n, row in sizes.items():
        size, prior = row[one] / max(row[other], 1), priors[n]
        out = F.when(order == n, F.log((F.col(one) + prior) / (F.col(other) * size + prior))).otherwise(out)
    return out


def _places(hashes: np.ndarray, orders: int, slots: int) -> np.ndarray:
    """Slots of all n-grams of a text's word hashes."""
    found, run = [hashes % np.uint64(slots)], hashes
    for n in range(1, orders):
        run = mixed(run[:-1], hashes[n:])
        found.append(run % np.uint64(slots) + np.uint64(n * slots))
    return np.concatenate(found).astype(np.int64)


def _counting(orders: int, slots: int):
    def run(batches):
        words, size = HashedWords(lambda h: h), orders * slots
        counts = [np.zeros(size, dtype=np.int64) for _ in range(4)]
        for batch in batches:
            good, toxic, clean = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("good", "toxic", "clean"))
            for start, texts in words.batches(batch.column("text")):
                places = [_places(hashes, orders, slots) for hashes in texts]
                marks = (np.ones(len(texts), dtype=bool), *(m[start : start + len(texts)] for m in (good, toxic, clean & ~toxic)))
                for n, (total, mark) in enumerate(zip(counts, marks)):
                    # of toxic and clean texts it counts in how many a slot is
                    if found := [np.unique(places[i]) if n > 1 else places[i] for i in np.flatnonzero(mark).tolist()]:
                        total += np.bincount(np.concatenate(found), minlength=size)
        used = np.flatnonzero(counts[0]).astype(np.int32)
        for part in np.array_split(used, len(used) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c[part]) for c in counts)], ["slot", "raw", "good", "toxic", "clean"])

    return run


def _scored(weights: Broadcast, orders: int, passage: int):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, (table, toxic) = HashedWords(lambda h: h), weights.value
        for column in columns:
            found, evidence = [], []
            for _, texts in words.batches(pa.array(column)):
                for hashes in texts:
                    at = _places(hashes, orders, len(table) // orders)
                    found.append(passage * float(table[at].mean(dtype=np.float64)) if len(at) else None)
                    evidence.append(float(toxic[at].max()) if len(at) else None)
            yield pd.DataFrame({"weight": pd.Series(found, dtype="Float64"), "evidence": pd.Series(evidence, dtype="Float64")})

    return pandas_udf(run, "weight double, evidence double")


def _kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the integers ``key``: counts by 16 bits at a time, at most 65,536 of them, lead down to it."""
    low, left = -(1 << 47), k
    for shift in (32, 16, 0):
        high = low + (1 << shift + 16) - 1
        digit = F.shiftrightunsigned(F.col("key") - F.lit(low), shift)
        counts = dict(keys.where(F.col("key").between(low, high)).groupBy(digit.alias("d")).count().collect())
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                low += d << shift
                break
            left -= counts[d]
    return low
