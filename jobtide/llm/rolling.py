"""Rolling hashes of byte strings with numpy."""

from __future__ import annotations

import numpy as np

from jobtide.llm.hashed_words import mixed

#: A 64-bit number for each byte value, drawn once from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gear(text: np.ndarray, width: int) -> np.ndarray:
    """Gear hash at each byte: the sum of the numbers of the last ``width`` (2^k) bytes, each shifted once for every byte after it."""
    value, span = GEAR[text], 1
    while span < width:
        later = value.copy()
        later[span:] += value[:-span] << np.uint64(span)
        value, span = later, span * 2
    return value


def names(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` (2^k) bytes from each position on, by doubling: that of twice as many from a pair of names."""
    value, span = GEAR[text], 1
    while span < length:
        value, span = mixed(value[:-span], value[span:]), span * 2
    return value


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest value, the first of equal ones, in each run of ``width`` values; only the upper 40 bits are compared."""
    n = len(values) - width + 1
    keys = values >> np.uint64(24) << np.uint64(24) | np.arange(len(values), dtype=np.uint64)
    padded = np.append(keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
