"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from jobtide.llm.common import blocks, texts_of
from jobtide.llm.vocab import merge_table, read_special

_NONE = np.int32(2**31 - 1)


def count_symbols(pieces: list[bytes], vocab_path: str) -> np.ndarray:
    """Symbols left of each pre-token once no merge applies.

    All pre-tokens lie in one ragged array. In each round every pre-token finds the pair of lowest rank it
    holds and joins all places of that pair at once; pre-tokens without a pair leave the array.
    """
    keys, ranks, made, of_byte = merge_table(vocab_path)
    counts = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)].astype(np.int64)
    who = np.repeat(np.arange(len(pieces)), counts)
    while len(flat) > 1:
        pair = flat[:-1] << 32 | flat[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.append(np.where((keys[at] == pair) & (who[:-1] == who[1:]), ranks[at], _NONE), _NONE)
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(who))))
        join = np.flatnonzero((rank == lowest) & (lowest != _NONE))
        if not len(join):
            break
        # of overlapping places, as in "aaa", every second one from the left is joined
        run = np.cumsum(np.append(True, np.diff(join) != 1))
        begin = join[np.append(True, run[1:] != run[:-1])]
        join = join[(join - begin[run - 1]) % 2 == 0]
        flat[join] = made[at[join]]
        keep = lowest != _NONE
        keep[join + 1] = False
        counts -= np.bincount(who[join], minlength=len(counts))
        flat, who = flat[keep], who[keep]
    return counts


def token_counts(
    docs: DataFrame, vocab_path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", known: int = 400_000
) -> DataFrame:
    """Tokens of every text under a byte-level BPE vocabulary (``.json``): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Special strings in a text count one token each, as the vocabulary's library has it. A null or empty text has
    no bytes and no tokens; repeated rows give repeated rows; a null id stays null. No shuffle. Counts of pre-tokens
    are remembered within a task, up to ``known`` of them, which bounds memory and changes no result.
    """

    def run(batches):
        special = read_special(vocab_path)
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        find, seen, sizes = regex.compile(pattern).findall, _Numbered(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in blocks(batch.column("text")):
                if len(seen) > known:
                    seen, sizes = _Numbered(), np.zeros(0, dtype=np.int64)
                places, extra = [], []
                for text in texts:
                    parts = cut.split(text) if cut else [text]
                    extra.append(len(parts) - 1)
                    found = find(text) if len(parts) == 1 else [x for part in parts for x in find(part)]
                    places.append(np.fromiter(map(seen.__getitem__, found), dtype=np.int64, count=len(found)))
                    n_bytes.append(len(text.encode()))
                new = list(seen)[len(sizes) :]
                if new:
                    sizes = np.concatenate([sizes, count_symbols([x.encode() for x in new], vocab_path)])
                n_tokens += [int(sizes[p].sum()) + e for p, e in zip(places, extra)]
            count = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(count, pa.int64()), pa.array(count > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number
