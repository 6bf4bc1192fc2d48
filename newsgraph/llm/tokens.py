"""Words of texts as byte ranges, for word classes given as sets of bytes; used inside tasks."""

from __future__ import annotations

import numpy as np


def member_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes that belong to words. Bytes from 0x80 on (parts of non-ASCII characters) always do."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for first, last in ranges:
        table[first : last + 1] = True
    return table


def word_ranges(
    data: np.ndarray, offsets: np.ndarray, members: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the range of words of each text. Words never cross texts."""
    inside = members[data]
    joined = np.zeros(len(data) + 1, bool)  # a byte and the one before it are in one text
    joined[1:-1] = True
    joined[offsets] = False
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & joined[1:-1])
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & joined[1:-1])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
