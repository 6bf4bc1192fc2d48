"""Substring dedup on word windows: super-k-mers travel to the bucket of their minimiser, sorting counts windows."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.arrays import RangeHash, byte_hash, words
from newsgraph.llm.repeats import Windows, apply_spans, as_words

WINDOW = 50  # words
GRAM = 8  # words of a minimiser


def _spans(pieces: list[bytes], earliest: np.ndarray, width: int = WINDOW):
    """Earliest document of every window that several packed strings of a bucket have, by exact sorting.

    Windows whose hash is unique in the bucket are left out first; the others are sorted by their words.
    """
    joined = b" ".join(pieces) + b" "
    data = np.frombuffer(joined, np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    starts, ends, ranges = words(data, borders)
    hashes = RangeHash(byte_hash(data)(starts, ends), "word").sliding(width)
    lengths = np.diff(ranges) - width + 1
    piece = np.repeat(np.arange(len(pieces)), lengths)
    window = np.arange(int(lengths.sum())) + np.repeat(ranges[:-1] - (np.cumsum(lengths) - lengths), lengths)
    own = hashes[window]
    order = np.argsort(own)
    equal = own[order][1:] == own[order][:-1]
    several = np.zeros(len(own), bool)
    several[order[1:][equal]] = True
    several[order[:-1][equal]] = True
    piece, window = piece[several], window[several]
    bounds = zip(starts[window].tolist(), ends[window + width - 1].tolist(), strict=True)
    text = [joined[a:b] for a, b in bounds]
    by_words = sorted(range(len(text)), key=text.__getitem__)
    first_of = np.zeros(len(text), np.int64)
    number = -1
    for k, i in enumerate(by_words):
        number += k == 0 or text[i] != text[by_words[k - 1]]
        first_of[i] = number
    least = np.full(number + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, first_of, earliest[piece])
    return piece, window - ranges[piece], np.full(len(piece), width), least[first_of]


KIND = Windows(as_words, WINDOW, GRAM, _spans, lambda piece: piece.count(b" ") + 1)


def _kept(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    mark = np.zeros(len(starts) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, end, -1)
    stay = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
    kept = b" ".join([text[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
    return len(starts), len(starts) - len(stay), kept


def _digest(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple:
    n, removed, kept = _kept(text, first, end)
    return n, removed, sha256(kept).hexdigest()


_NONE = np.zeros(0, np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``; see ``dedup``."""
    return apply_spans(
        _rows(docs, id_col, text_col),
        KIND,
        _digest,
        lambda text: _digest(text, _NONE, _NONE),
        "n_words long, n_removed long, kept_sha256 string",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per input row: words covered by a 50-word window that also starts in
    a document with a smaller id are gone, the others are joined by one blank.

    Defined results: a NULL text has no words. Documents under 50 words lose nothing. Rows that repeat an id never
    remove words of each other. A row with a NULL id loses nothing and removes nothing. Empty input: no rows.
    """
    out = apply_spans(
        _rows(docs, id_col, text_col),
        KIND,
        _kept,
        lambda text: _kept(text, _NONE, _NONE),
        "n_words long, n_removed long, kept_text binary",
    )
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8"))
