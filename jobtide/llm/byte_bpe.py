"""Byte-level BPE: overlapping chunk encoding, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from jobtide.llm.common import blocks, row_key, texts_of
from jobtide.llm.vocab import merge_piece, read_ranks


def encode(
    docs: DataFrame,
    vocab_path: str,
    pattern: str,
    chunk: int = 32_768,
    overlap: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: int = 200_000,
) -> DataFrame:
    """Ids of every text under a rank file: doc_id, n_tokens, ids (little-endian unsigned 32-bit, one after another).

    A text of up to ``chunk`` characters is one chunk and is encoded where it lies. A longer one is cut into chunks that
    overlap by ``overlap`` characters; they are pre-tokenised in parallel and stitched at the first boundary that both sides
    of an overlap share, from where on they agree, as the pattern never looks back. The pieces between are encoded in
    parallel and put together again. Where the two sides of an overlap share no boundary (a run of blanks or letters longer
    than it), the text is not cut from there on, so every result is that of the whole text. Null and empty texts have no ids; repeated rows give
    repeated rows; a null id stays null.
    """
    rows = texts_of(docs, id_col, text_col)
    short, longer = rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)
    key = rows.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {key}, doc long, sig long, piece long, ids binary"
    one = short.withColumns({"doc": F.lit(0).cast("long"), "sig": F.lit(0).cast("long"), "piece": F.lit(0).cast("long")})
    whole = one.mapInArrow(_encoding(vocab_path, pattern, known), made).select("doc_id", "ids")

    named = longer.withColumns(dict(zip(("doc", "sig"), row_key(longer))))
    parts = _pieces(named.dropDuplicates(["doc", "sig"]), pattern, chunk, overlap)
    ids = parts.repartition("doc", "sig", "piece").mapInArrow(_encoding(vocab_path, pattern, known), made)
    joined = ids.groupBy("doc", "sig").agg(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("ids")))).alias("parts"))
    joined = joined.select("doc", "sig", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"))
    again = named.select("doc_id", "doc", "sig").join(joined, ["doc", "sig"]).select("doc_id", "ids")
    return whole.unionByName(again).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Bytes of encoded texts: doc_id, bytes. Joins the bytes of each id; no ids give no bytes."""

    def run(batches):
        ranks = read_ranks(vocab_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                texts = [b"".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist())) for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    key = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, bytes binary")


def _pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Long texts cut where their chunks resynchronise: doc_id, doc, sig, piece, text."""
    count = F.ceil(F.length("text") / chunk)
    cut = texts.select("doc", "sig", "text", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    cut = cut.select("doc", "sig", "piece", F.substring("text", (F.col("piece") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("text"))
    edges = cut.repartition("doc", "sig", "piece").mapInArrow(_edges(pattern, chunk), "doc long, sig long, piece long, head array<long>, tail array<long>")
    order = Window.partitionBy("doc", "sig").orderBy("piece")
    meet = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    edges = edges.withColumn("at", meet)
    sure = F.sum(F.col("at").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0
    edges = edges.withColumn("sure", sure).where("sure")
    edges = edges.select("doc", "sig", "piece", "at", F.lead("at").over(order).alias("to"))
    both = texts.join(edges, ["doc", "sig"])
    length = F.coalesce(F.col("to"), F.length("text").cast("long")) - F.col("at")
    return both.select("doc_id", "doc", "sig", "piece", F.substring("text", (F.col("at") + 1).cast("int"), length.cast("int")).alias("text"))


def _edges(pattern: str, chunk: int):
    """Boundaries of each chunk within the two overlaps it is part of, as positions in the whole text."""

    def run(batches):
        starts = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for piece, text in zip(batch.column("piece").to_pylist(), batch.column("text").to_pylist()):
                # the last match may go on beyond the chunk, so what follows its start is not known
                found = np.array([m.start() for m in starts(text)], dtype=np.int64)
                heads.append((found[found < max(0, len(text) - chunk)] + piece * chunk).tolist())
                tails.append((found[found >= chunk] + piece * chunk).tolist())
            kept = [batch.column(c) for c in ("doc", "sig", "piece")]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*kept, *lists], ["doc", "sig", "piece", "head", "tail"])

    return run


def _encoding(vocab_path: str, pattern: str, known: int):
    """Encode the texts of Arrow batches; ids of pre-tokens are remembered, up to ``known`` of them."""

    def run(batches):
        ranks, find = read_ranks(vocab_path), regex.compile(pattern).findall
        memory = _Memory(ranks)
        for batch in batches:
            # a block's ids go out before the next block is read, so a task holds those of one block
            for begin, texts in blocks(batch.column("text")):
                if len(memory) > known:
                    memory = _Memory(ranks)
                places = []
                for text in texts:
                    found = find(text)
                    places.append(np.fromiter(map(memory.__getitem__, found), dtype=np.int64, count=len(found)))
                flat, start, size = memory.tables()
                out = [flat[_spread(start[p], size[p])].tobytes() for p in places]
                part = batch.slice(begin, len(texts))
                kept = [part.column(c) for c in ("doc_id", "doc", "sig", "piece")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], ["doc_id", "doc", "sig", "piece", "ids"])

    return run


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Memory(dict):
    """Numbers pre-tokens as they come and keeps their ids, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self._ranks, self._ids, self._sizes = ranks, [], []
        self._made = (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def __missing__(self, piece: str) -> int:
        ids = merge_piece(piece.encode(), self._ranks)
        number = self[piece] = len(self)
        self._ids += ids
        self._sizes.append(len(ids))
        return number

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, start, size = self._made
        if self._sizes:
            flat = np.concatenate([flat, np.array(self._ids, dtype="<u4")])
            size = np.concatenate([size, np.array(self._sizes, dtype=np.int64)])
            self._made = (flat, np.cumsum(size) - size, size)
            self._ids, self._sizes = [], []
        return self._made
