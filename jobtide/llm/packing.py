"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.vocab import merge_piece, read_ranks, read_special

#: Sequence numbers of one task lie below this, so that no two tasks share one.
_PER_TASK = 1 << 40


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents packed into as few sequences of ``size`` as their tokens need.

    Documents go by descending length, each to the sequence of lowest cost (linear * n + quadratic * n * n over
    its pieces) among those with room for it; one that fits nowhere whole fills the largest room left and its
    rest waits for its turn. Tokens beyond the last full sequence go to sequences of 2^k tokens, so that none
    is padded. Documents longer than a sequence are cut to full ones first.
    """
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for doc, length in enumerate(lengths):
        for start in range(0, length, size):
            waiting[min(size, length - start)].append((doc, start))
    total = sum(lengths)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length()) if (total % size) >> b & 1]
    used, cost = [0] * len(room), [0.0] * len(room)
    parked: dict[int, list[int]] = defaultdict(list)
    for s, r in enumerate(room):
        parked[r].append(s)
    ready: list[tuple[float, int]] = []
    out = []

    def place(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, used[s]))
        used[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n in range(size, 0, -1):
        for s in parked.pop(n, ()):
            heapq.heappush(ready, (cost[s], s))
        for doc, start in waiting.pop(n, ()):
            if ready:
                _, s = heapq.heappop(ready)
                place(doc, start, n, s)
                if room[s] >= n:
                    heapq.heappush(ready, (cost[s], s))
                elif room[s]:
                    parked[room[s]].append(s)
            else:
                r = max(parked)
                s = parked[r].pop()
                if not parked[r]:
                    del parked[r]
                place(doc, start, r, s)
                waiting[n - r].append((doc, start + r))
    return out


def encoder(vocab_path: str, pattern: str):
    """Function from a text to its token ids; special strings in a text become their own ids."""
    ranks, special = read_ranks(vocab_path), read_special(vocab_path)
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
    find = regex.compile(pattern).findall

    def plain(text: str) -> list[int]:
        return [i for piece in find(text) for i in merge_piece(piece.encode(), ranks)]

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # the library gives up on runs of a million blanks
            pass
        ids, at = [], 0
        for m in cut.finditer(text):
            ids += [*plain(text[at : m.start()]), special[m[0]]]
            at = m.end()
        return ids + plain(text[at:])

    return encode


def pack(
    docs: DataFrame,
    vocab_path: str,
    pattern: str,
    size: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 4608,
    window: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all texts into training sequences of at most ``size`` tokens (a power of two).

    A text is its ids under the vocabulary and then ``end_id``; a null or empty text is that id alone. Each task packs its
    own rows, ``window`` tokens at a time and without a shuffle; the last document of a window goes on in the next
    one, so that only the end of a task leaves sequences shorter than ``size``, of 2^k tokens each. Costs default to
    those of a decoder 768 wide. One row per piece: doc_id, start, length, tokens (little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset. Repeated rows are packed as often as they come; a null id stays null.
    """

    def run(batches):
        encode, number, held = encoder(vocab_path, pattern), TaskContext.get().partitionId() * _PER_TASK, []

        def emit(last: bool):
            nonlocal number, held
            rest, spare = [], 0 if last else sum(stop - start for _, _, start, stop in held) % size
            while spare:
                key, ids, start, stop = held.pop()
                cut = max(start, stop - spare)
                spare -= stop - cut
                rest.append((key, ids, cut, stop))
                if cut > start:
                    held.append((key, ids, start, cut))
            rows = assign([stop - start for _, _, start, stop in held], size, linear, quadratic)
            columns = list(zip(*rows)) or [()] * 5
            starts = [held[d][2] + s for d, s, *_ in rows]
            found = [held[d][1][a : a + n].tobytes() for (d, _, n, *_), a in zip(rows, starts)]
            tokens = [len(held[d][1]) for d in columns[0]]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in columns[0]], kind),
                    pa.array(starts, pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(found, pa.binary()),
                    pa.array(tokens, pa.int64()),
                    pa.array([number + s for s in columns[3]], pa.int64()),
                    pa.array(columns[4], pa.int64()),
                ],
                ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"],
            )
            number += 1 + max(columns[3], default=-1)
            held = rest[::-1]
            return batch

        size_held, kind = 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            for first, texts in blocks(batch.column("text")):
                for i, text in enumerate(texts, first):
                    ids = np.array([*encode(text), end_id], dtype="<u4")
                    held.append((keys[i], ids, 0, len(ids)))
                    size_held += len(ids)
                    if size_held >= window:
                        yield emit(False)
                        size_held = sum(stop - start for _, _, start, stop in held)
        if held:
            yield emit(True)

    rows = texts_of(docs, id_col, text_col)
    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long")
