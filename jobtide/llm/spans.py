"""Taking byte spans out of texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from jobtide.llm.common import row_key, texts_of


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """doc_id, text and the key (doc, sig) of each row; with ``carry`` also ``carried``, a struct of all columns but the text, by their place, and whether the text is null."""
    struct = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.col(f"`{text_col}`").isNull().alias("no_text"))
    texts = texts_of(docs, id_col, text_col, *([struct.alias("carried")] if carry else []))
    return texts.withColumns(dict(zip(("doc", "sig"), row_key(texts))))


def carried(docs: DataFrame, text_col: str, text: Column) -> list[Column]:
    """The columns of ``docs`` out of a ``carried`` struct, with ``text`` in the place of the text."""
    return [(text if c == text_col else F.col(f"carried.c{i}")).alias(c) for i, c in enumerate(docs.columns)]


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, stop) as maximal disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def without_spans(rows: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """Texts without spans of their bytes: doc_id, kept (binary), n_bytes, spans (maximal removed runs of ``least`` bytes or more).

    ``rows``: doc_id, text, doc, sig, and carried, which stays, or not. ``spans``: doc, sig, start, stop; a row's spans come together with its text, which is longer.
    """
    lists = spans.groupBy("doc", "sig").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    stays = [c for c in ("doc_id", "carried") if c in rows.columns]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in stays)

    def run(batches):
        for batch in batches:
            kept, sizes, gone = [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode()
                out = [s for s in joined_spans([(x["start"], x["stop"]) for x in found.as_py() or ()]) if s[1] - s[0] >= least]
                at = [0, *(x for s in out for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2])))
                sizes.append(len(data))
                gone.append([{"start": a, "stop": b} for a, b in out])
            pairs = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, stays), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pairs], [*stays, "kept", "n_bytes", "spans"]
            )

    both = rows.join(lists, ["doc", "sig"], "left").select(*stays, "text", "spans")
    return both.mapInArrow(run, f"{kinds}, kept binary, n_bytes long, spans array<struct<start:long,stop:long>>")
