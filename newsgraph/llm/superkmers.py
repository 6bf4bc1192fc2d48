"""Windows of a fixed width, grouped by their minimiser; used inside tasks.

The minimiser of a window is the smallest hash among the shorter grams in it. Equal windows have equal minimisers,
so they meet wherever rows are dealt out by it, and consecutive windows mostly share it, so they travel as one
packed string (a super-k-mer).
"""

from __future__ import annotations

import numpy as np

LONGEST_RUN = 512  # windows in one packed string; a run that is longer (a repeated symbol) is cut


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(
    gram_hashes: np.ndarray, ranges: np.ndarray, width: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of all texts: text number, first window (absolute), number of windows, minimiser.

    ``gram_hashes[i]`` is the hash of the gram at i, ``ranges`` the borders of the texts. Windows never cross them.
    """
    least = sliding_min(gram_hashes, width - gram + 1)
    lengths = np.maximum(np.diff(ranges) - width + 1, 0)
    total = int(lengths.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    window = np.arange(total) + np.repeat(ranges[:-1] - first, lengths)
    own = least[window]
    new = np.ones(total, bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, total))
    if sizes.max() > LONGEST_RUN:
        parts = -(-sizes // LONGEST_RUN)
        again = np.repeat(begin, parts) + LONGEST_RUN * (
            np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        )
        begin = again
        sizes = np.diff(np.append(begin, total))
    return text[begin], window[begin], sizes, own[begin]
