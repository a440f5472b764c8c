"""Substring dedup by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobtide.llm.rolling import gear
from jobtide.llm.spans import keyed, without_spans


def boundaries(data: bytes, least: int, average: int, most: int, width: int = 16) -> list[int]:
    """Ends of the chunks of a text: where the gear hash of the last ``width`` bytes is one of every ``average - least``,
    at least ``least`` and about ``most`` bytes apart, and never inside a UTF-8 character.

    They depend on nearby bytes alone, so that chunks fall into step again soon after an insertion.
    """
    text = np.frombuffer(data, dtype=np.uint8)
    whole = np.append((text[1:] & 0xC0) != 0x80, True) if len(text) else np.zeros(0, dtype=bool)
    good = np.flatnonzero(((gear(text, width) >> np.uint64(40)) % np.uint64(average - least) == 0) & whole) + 1
    ends, last = [], 0
    for end in [*good.tolist(), len(data)]:
        while end - last > most:
            last += most
            while not whole[last - 1]:
                last += 1
            ends.append(last)
        if end - last >= least or end == len(data) > last:
            ends.append(end)
            last = end
    return ends


def dedup(
    docs: DataFrame,
    least: int = 16,
    average: int = 40,
    most: int = 256,
    min_run: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Take repeated passages out of all texts but the first: doc_id, kept (UTF-8), n_bytes, spans (removed, as start and stop byte).

    Texts are cut into content-defined chunks. Of equal chunks the one of the lowest id (then text hash, then place) is the first;
    others go where neighbouring ones make up ``min_run`` bytes or more. Rows equal in id and text count as one
    and keep the same text. A null text is empty; null ids come first. Only digests are shuffled to find repeats, counted before the
    shuffle; those of repeated chunks then go to their texts. With ``carry`` the other columns stay in a struct ``carried``.
    """
    rows = keyed(docs, id_col, text_col, carry)

    def run(batches):
        for batch in batches:
            doc, sig, lengths, digests, starts, sizes = batch.column("doc").to_numpy(), batch.column("sig").to_numpy(), [], [], [], []
            for text in batch.column("text"):
                data = text.as_py().encode()
                ends = boundaries(data, least, average, most)
                begins = [0, *ends[:-1]]
                digests += [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begins, ends)]
                starts += begins[: len(ends)]
                sizes += [b - a for a, b in zip(begins, ends)]
                lengths.append(len(ends))
            columns = [np.repeat(doc, lengths), np.repeat(sig, lengths), np.array(digests, dtype=np.uint64).view(np.int64)]
            columns += [np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "sig", "digest", "start", "size"])

    chunks = rows.select("doc", "sig", "text").mapInArrow(run, "doc long, sig long, digest long, start long, size int")
    first = chunks.groupBy("digest", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc", "sig", "start")).alias("first"))
    again = chunks.join(first.where("n > 1"), ["digest", "size"])
    again = again.where(F.struct("doc", "sig", "start") != F.col("first"))
    spans = again.select("doc", "sig", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
    return without_spans(rows, spans, min_run)
