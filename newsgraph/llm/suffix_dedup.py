"""Suffix-array dedup on bytes: the interval tree of an enhanced suffix array gives maximal repeats with all their
occurrences."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.arrays import byte_hash
from newsgraph.llm.repeats import Windows, apply_spans, as_bytes

WINDOW = 50  # bytes
GRAM = 16
DEPTH = 72  # bytes that the suffix order looks at


def _suffixes(pieces: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Of each suffix that may repeat: piece, place, remaining bytes, the byte before it, and its first DEPTH bytes
    as big-endian numbers (zeros after the end of the piece).

    A suffix whose first ``width`` bytes occur once lies in no interval of that depth and is left out.
    """
    data = np.frombuffer(b"".join(pieces) + bytes(DEPTH), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    base = np.cumsum(sizes) - sizes
    lengths = sizes - width + 1
    piece = np.repeat(np.arange(len(pieces)), lengths)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = base[piece] + inside
    own = byte_hash(data)(at, at + width)
    order = np.argsort(own)
    equal = own[order][1:] == own[order][:-1]
    several = np.zeros(len(own), bool)
    several[order[1:][equal]] = True
    several[order[:-1][equal]] = True
    piece, inside, at = piece[several], inside[several], at[several]
    rest = sizes[piece] - inside
    heads = np.lib.stride_tricks.sliding_window_view(data, DEPTH)[at]
    heads[np.arange(DEPTH) >= rest[:, None]] = 0
    return piece, inside, rest, data[at - 1], heads.view(">u8").astype(np.uint64)


def _enhanced(heads: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order to DEPTH bytes and the common prefix of each suffix with the one before it."""
    n = len(rest)
    keys = list(heads.T)
    order = np.lexsort([rest, *keys[::-1]])  # the end of a piece is before a NUL byte, which looks the same
    common = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    open_[:1] = False
    for key in keys:
        key = key[order]
        differs = np.zeros(n, np.uint64)
        differs[1:] = key[1:] ^ key[:-1]
        same = open_ & (differs == 0)
        part = open_ & (differs != 0)
        top = differs[part]
        bytes_equal = np.zeros(len(top), np.int64)
        for k in range(1, 8):
            bytes_equal += top < (np.uint64(1) << np.uint64(64 - 8 * k))
        common[part] += bytes_equal
        common[same] += 8
        open_ = same
    rest = rest[order]
    common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    return order, common


def repeat_tree(
    pieces: list[bytes], width: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, int, int]]]:
    """Piece and place of the suffixes in order, and the maximal repeats as (length, first suffix, end).

    One scan over the common prefixes with a stack visits the intervals of the tree bottom-up. An interval is a
    maximal repeat if its occurrences have different left neighbours; the start of a piece counts as different from
    everything. Repeats of DEPTH bytes may be longer and are reported without that test.
    """
    piece, place, rest, before, heads = _suffixes(pieces, width)
    if not len(piece):
        return piece, place, iter(())
    order, common = _enhanced(heads, rest)
    piece, place = piece[order], place[order]
    left = np.where(place > 0, before[order].astype(np.int64), -1 - np.arange(len(place)))
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]).tolist()  # equal all along: not diverse
    values = common.tolist() + [0]

    def scan() -> Iterator[tuple[int, int, int]]:
        stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
        for i in range(1, len(values)):
            first = i - 1
            while stack and stack[-1][0] > values[i]:
                length, first = stack.pop()
                if length >= DEPTH or changes[i - 1] != changes[first]:
                    yield length, first, i
            if values[i] >= width and (not stack or stack[-1][0] < values[i]):
                stack.append((values[i], first))

    return piece, place, scan()


def maximal_repeats(pieces: list[bytes], width: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``width`` bytes: length, and piece and place of every occurrence."""
    piece, place, found = repeat_tree(pieces, width)
    for length, first, end in found:
        yield length, piece[first:end], place[first:end]


def _spans(pieces: list[bytes], earliest: np.ndarray):
    """A wider interval gives a shorter span, so it adds to an occurrence only if its earliest document is earlier
    than that of every interval inside it; what adds nothing is not kept."""
    piece, place, found = repeat_tree(pieces)
    document = earliest[piece]  # of the intervals so far; at first the document of the occurrence itself
    which, lengths, documents = [], [], []
    for length, first, end in found:
        inside = document[first:end]
        least = inside.min()
        adds = np.flatnonzero(inside > least) + first
        if len(adds):
            document[adds] = least
            which.append(adds.astype(np.int32))
            lengths.append(length)
            documents.append(least)
    sizes = [len(w) for w in which]
    at = np.concatenate(which) if which else np.zeros(0, np.int32)
    return piece[at], place[at], np.repeat(np.array(lengths, np.int64), sizes), np.repeat(
        np.array(documents, np.int64), sizes
    )


KIND = Windows(as_bytes, WINDOW, GRAM, _spans, len)


def _kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
    borders = [0, *np.stack([first, end], 1).ravel().tolist(), len(text)]
    kept = b"".join([text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)])
    return len(text), int((end - first).sum()), len(first), kept


def _digest(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
    *counts, kept = _kept(text, first, end)
    return *counts, sha256(kept).hexdigest()


_NONE = np.zeros(0, np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; see ``dedup``."""
    return apply_spans(
        _rows(docs, id_col, text_col),
        KIND,
        _digest,
        lambda text: _digest(text, _NONE, _NONE),
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` per input row: bytes covered by a 50-byte string that also starts
    in a document with a smaller id are gone; ``kept`` is binary, because a cut may fall inside a character.

    Defined results: a NULL text is empty. Texts under 50 bytes lose nothing. Rows that repeat an id never remove
    bytes of each other. A row with a NULL id loses nothing and removes nothing. Empty input: no rows.
    """
    return apply_spans(
        _rows(docs, id_col, text_col),
        KIND,
        _kept,
        lambda text: _kept(text, _NONE, _NONE),
        "n_bytes long, n_removed long, n_spans long, kept binary",
    )
