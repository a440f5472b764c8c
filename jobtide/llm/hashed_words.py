"""Words of texts as numbers, for models that count hashed words inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

from jobtide.llm.common import blocks

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hash of pairs of 64-bit numbers."""
    x = (a ^ (a >> np.uint64(32))) * _MIX + np.asarray(b).astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class HashedWords:
    """Turns texts into arrays of what ``look_up`` gives for the hashes of their words.

    Words are in small letters as far as ASCII goes, split at ASCII white space. What was looked up is remembered
    for up to ``known`` different words and then forgotten, which bounds memory and changes no result.
    """

    def __init__(self, look_up: Callable[[np.ndarray], np.ndarray], known: int = 400_000):
        self._look_up, self._most = look_up, known
        self._forget()

    def _forget(self) -> None:
        self._numbers, self._values = _Numbers(), self._look_up(np.zeros(0, dtype=np.uint64))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._numbers) > self._most:
            self._forget()
        number, places = self._numbers.__getitem__, []
        for text in texts:
            words = text.encode().lower().split()
            places.append(np.fromiter(map(number, words), dtype=np.int64, count=len(words)))
        if new := self._numbers.new():
            self._values = np.concatenate([self._values, self._look_up(np.array(new, dtype=np.uint64))])
        return [self._values[p] for p in places]

    def batches(self, column: pa.Array, *most: int):
        """Runs of the column's texts as such arrays, with the place of the first; ``most`` characters or so each, if given."""
        for start, texts in blocks(column, *most):
            yield start, self.of(texts)


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self._new: list[int] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self._new.append(hash_word(word))
        return number

    def new(self) -> list[int]:
        found, self._new = self._new, []
        return found


#: The hash of a text's end. No word holds a blank.
END = np.uint64(hash_word(b" "))
#: What stands for the end of a text among its bytes: one that UTF-8 never has.
_MARK = b" \xff "
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
#: The first bytes of XXH3's secret, as 64-bit numbers.
_SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e"), dtype="<u8")
_FLIP = int(_SECRET[0]) >> 32 ^ int(_SECRET[0]) & 0xFFFFFFFF, _SECRET[1] ^ _SECRET[2], _SECRET[3] ^ _SECRET[4], _SECRET[5] ^ _SECRET[6]


def token_hashes(texts: list[str], part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, each text with its end, and the numbers of them in each text.

    Words are as in ``HashedWords`` and hashes those of ``hash_word``, worked out for the words of about ``part`` bytes at once, so that only words of over 16 bytes are
    looked at one by one.
    """
    if not texts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(_MARK.join(t.encode() for t in texts) + _MARK, dtype=np.uint8)
    found, ends, start, n = [], [], 0, 0
    while start < len(data):
        stop = min(start + part, len(data))
        while stop < len(data) and not _GAP[data[stop - 1]]:
            stop += 1
        piece = data[start:stop]
        change = np.flatnonzero(np.diff(_GAP[piece], prepend=True, append=True))
        first, size = change[::2], change[1::2] - change[::2]
        hashes, last = _hashes(_LOWER[piece], first, size), piece[first] == _MARK[1]
        hashes[last] = END
        found.append(hashes)
        ends.append(np.flatnonzero(last) + n)
        n += len(first)
        start = stop
    return np.concatenate(found), np.diff(np.concatenate(ends), prepend=-1)


def _hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 of strings of the data, by its rules for 1 to 3, 4 to 8 and 9 to 16 bytes."""
    out = np.empty(len(first), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    u = np.uint64
    short, mid, long = size < 4, (size > 3) & (size < 9), (size > 8) & (size < 17)
    at, n = first[short], size[short]
    x = data[at].astype(u) << u(16) | data[at + (n >> 1)].astype(u) << u(24) | data[at + n - 1] | n.astype(u) << u(8)
    x ^= u(_FLIP[0])
    x = (x ^ x >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> u(29)) * u(0x165667B19E3779F9)
    out[short] = x ^ x >> u(32)
    at, n = first[mid], size[mid]
    x = ((eight[at + n - 4] & u(0xFFFFFFFF)) + (eight[at] << u(32))) ^ _FLIP[1]
    x ^= (x << u(49) | x >> u(15)) ^ (x << u(24) | x >> u(40))
    x *= u(0x9FB21C651E98DF25)
    x = (x ^ (x >> u(35)) + n.astype(u)) * u(0x9FB21C651E98DF25)
    out[mid] = x ^ x >> u(28)
    at, n = first[long], size[long]
    low, high = eight[at] ^ _FLIP[2], eight[at + n - 8] ^ _FLIP[3]
    x = n.astype(u) + low.byteswap() + high + _folded(low, high)
    x = (x ^ x >> u(37)) * u(0x165667919E3779F9)
    out[long] = x ^ x >> u(32)
    whole = data.tobytes() if (rest := np.flatnonzero(size > 16)).size else b""
    out[rest] = [hash_word(whole[i : i + k]) for i, k in zip(first[rest].tolist(), size[rest].tolist())]
    return out


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of 128-bit products, one over the other."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    cross, back = (a >> half) * (b & low), (a & low) * (b >> half)
    carry = ((a & low) * (b & low) >> half) + (cross & low) + (back & low)
    return a * b ^ (a >> half) * (b >> half) + (cross >> half) + (back >> half) + (carry >> half)
