"""Byte-level BPE vocabularies from the files of public tokenizers, and the merge loop that they define."""

from __future__ import annotations

import base64
import heapq
import json
from functools import cache

import numpy as np


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token to its id, from a ``.tiktoken`` file or the vocabulary of a byte-level ``.json`` file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special, letters = read_special(path), byte_letters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}


@cache
def read_special(path: str) -> dict[str, int]:
    """Special strings of a ``.json`` tokenizer with their ids; a ``.tiktoken`` file has none."""
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@cache
def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges of a ``.json`` file: sorted pair keys (left id << 32 | right id), their ranks, the ids they give; and the id of each byte."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
    order = np.argsort(keys, kind="stable")
    of_byte = np.zeros(256, dtype=np.int32)
    for letter, b in letters.items():
        of_byte[b] = vocab[letter]
    return keys[order], order.astype(np.int32), made[order], of_byte


_SHORT, _NEVER = 48, 1 << 62


def _short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    rank_of, n = ranks.get, len(piece)
    cuts = list(range(n + 1))
    waiting = [rank_of(piece[i : i + 2], _NEVER) for i in range(n - 1)]
    while waiting and (lowest := min(waiting)) != _NEVER:
        i = waiting.index(lowest)
        del cuts[i + 1], waiting[i]
        if i:
            waiting[i - 1] = rank_of(piece[cuts[i - 1] : cuts[i + 1]], _NEVER)
        if i < len(waiting):
            waiting[i] = rank_of(piece[cuts[i] : cuts[i + 2]], _NEVER)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the neighbours of lowest rank, the leftmost first, until none can be joined.

    A heap of candidate joins keeps long pieces at n log n steps; short ones are quicker looked through for their lowest rank.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= _SHORT:
        return _short(piece, ranks)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(waiting)
    gone = bytearray(n)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        if gone[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(waiting, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(waiting, (r, k, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids
