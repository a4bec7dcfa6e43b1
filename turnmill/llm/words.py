"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from turnmill.llm.columns import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64))

#: Bytes of search terms: ASCII letters and digits, and all of other scripts.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1 … of every run."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def hashed_words(data: np.ndarray, limits: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in order: the maximal runs of bytes that are
    ``member``, A-Z lower-cased, which end with their row."""
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = limits[:-1][limits[:-1] < limits[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    longest = int(lengths.max())
    power = np.multiply.accumulate(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.add.reduceat(_BYTE[_LOWER[data[kept]]] * power[_places(lengths)], first)
    return mix(sums), np.searchsorted(limits, starts, "right") - 1


def term_counts(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of every row (ascending by row and hash): row, hash, count."""
    if not len(words):
        return rows, words, np.zeros(0, np.int64)
    order = np.lexsort((words, rows))
    words, rows = words[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (rows[1:] != rows[:-1]))))
    return rows[new], words[new], np.diff(np.append(new, len(words)))
