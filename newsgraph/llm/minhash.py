"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from hashlib import blake2b
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.arrays import RangeHash, WordHash, mix, words
from newsgraph.llm.common import map_arrow, text_chunks
from newsgraph.llm.components import components
from newsgraph.llm.membership import BitTable, bit_table
from newsgraph.session import stored

SHINGLE = 5
LINK_PERCENT = 85  # documents link when 100 * intersection >= this * union
MISSED = 2e-6  # a pair at the link similarity shares no band with this probability at most
VALUES = 170  # values of a signature, two per permutation, because each keeps its minimum and its maximum
CELL = 1 << 20  # shingles that are compared in one task at a time
ID_BITS = 1 << 26


@cache
def banding(percent: int) -> tuple[int, int]:
    """Values of a band and number of bands: the longest bands for which ``VALUES`` values keep to ``MISSED``.

    85 percent: 28 bands of 6; 80 percent: 34 bands of 5. Where even bands of one value need more, there are more.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    for rows in range(VALUES // 2, 0, -1):
        equal = (percent / 100) ** rows
        pairs = max(1, ceil(log(MISSED) / log1p(-equal) / 2)) if equal < 1 else 1
        if rows == 1 or 2 * pairs * rows <= VALUES:
            return rows, 2 * pairs
    raise AssertionError


@cache
def _permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(85)
    factors = random.integers(1, 1 << 63, number, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, random.integers(0, 1 << 63, number, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a shorter text is one shingle. A shingle is a
    polynomial of at most ``width`` hashed words, each mixed and drawn (``WordHash``)."""
    starts, ends, ranges = words(data, offsets)
    word = WordHash(data)(starts, ends)
    shingle = RangeHash(word, "word")
    runs = shingle.sliding(width)
    out = []
    for first, last in zip(ranges[:-1], ranges[1:], strict=True):
        if last - first >= width:
            out.append(np.unique(runs[first : last - width + 1]))
        elif last > first:
            out.append(shingle(np.array([first]), np.array([last])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray], percent: int = LINK_PERCENT) -> np.ndarray:
    """A 64-bit key per set and band. Every set must have a member."""
    length, bands = banding(percent)
    factors, shifts = _permutations(length * bands // 2)
    values = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    keys = np.zeros((len(sets), bands), np.uint64)
    for k in range(len(factors)):
        permuted = values * factors[k] + shifts[k]
        # Minima fill the first half of the bands and maxima the second, so both of one permutation never meet.
        for half, found in enumerate((np.minimum.reduceat(permuted, at), np.maximum.reduceat(permuted, at))):
            band = half * (bands // 2) + k // length
            keys[:, band] = mix(keys[:, band] ^ found) + np.uint64(band)
    return keys


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, "text"):
        sets = shingle_sets(data, offsets)
        sizes = np.array([len(s) for s in sets], np.int64)
        filled = np.flatnonzero(sizes)
        keys = band_keys([sets[i] for i in filled], percent) if len(filled) else np.zeros((0, 0), np.uint64)
        bands: list = [None] * len(sets)
        for i, own in zip(filled, keys.view(np.int64), strict=True):
            bands[i] = own
        digests = [_digest(s) if len(s) else None for s in sets]
        yield pa.record_batch(
            [rows.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_key", "bands"],
        )


def _candidate_sets(table: BitTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            ids = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(table.perhaps(ids.view(np.uint64)))
            if not len(hit):
                continue
            lengths = np.diff(offsets)[hit]
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in hit])
            sets = shingle_sets(part, np.concatenate([[0], np.cumsum(lengths)]))
            contents = [[_digest(s) for s in sets], [s.tobytes() for s in sets]]
            yield pa.record_batch(
                [rows.column(0).take(pa.array(hit)), *(pa.array(c, pa.binary()) for c in contents)],
                ["node", "set_key", "shingles"],
            )

    return run


def links_of(ids: np.ndarray, sets: list[np.ndarray], percent: int = LINK_PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets: every link is between members of one tree.

    Shared shingles are counted through posting lists, one document against all later ones at a time.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    by_code = np.argsort(code, kind="stable")  # owners of a code stay in rising order
    posting_owner, sorted_code = owner[by_code], code[by_code]
    ends = np.searchsorted(sorted_code, code, "right")
    place = np.empty(len(code), np.int64)
    place[by_code] = np.arange(len(code))
    ranges = np.searchsorted(owner, np.arange(n + 1))
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, trees = [], n
    for i in range(n):
        own = slice(ranges[i], ranges[i + 1])
        lengths = ends[own] - place[own] - 1  # later owners of each of this document's shingles
        total = int(lengths.sum())
        if not total or trees == 1:
            continue
        begin = np.repeat(place[own] + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        common = np.bincount(posting_owner[begin + np.arange(total)], minlength=n)
        union = sizes[i] + sizes - common
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * union)):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                trees -= 1
                out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell. Whole cells are gathered up to CELL shingles and compared together; what small
    cells of one task find across each other are true links as well. Every distinct set of a node is compared."""
    ids: list[int] = []
    sets: list[bytes] = []
    mass, cell = 0, None

    def done() -> pa.RecordBatch:
        distinct = sorted(set(zip(ids, sets, strict=True)))
        nodes = np.array([node for node, _ in distinct], np.int64)
        found = links_of(nodes, [np.frombuffer(s, np.uint64) for _, s in distinct], percent)
        return pa.record_batch(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        for at, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != cell and mass >= CELL:
                yield done()
                ids, sets, mass = [], [], 0
            cell = at
            ids.append(node)
            sets.append(data)
            mass += len(data) // 8
    if len(ids) > 1:
        yield done()


def _families(members: DataFrame) -> DataFrame:
    """``node, set_key, cell``: the comparisons that cover all candidate pairs, each cell at most about CELL shingles.

    Documents that share a band, directly or in a chain, are a family. A family above the bound is cut into blocks
    by hash and every two of its blocks form a cell, so no group of any size lies in one task and no pair is lost.
    """
    # A star per band: the smallest document of a bucket stands for it.
    stars = members.select(F.col("node").alias("a"), F.col("_least").alias("b")).where("a <> b").distinct()
    family = components(stars)
    sets = members.select("node", "set_key", "n_shingles").distinct()
    sized = stored(family.join(sets, "node"), "family_sizes")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") * 2 / CELL).alias("_blocks"))
    placed = sized.join(blocks, "component").withColumn(
        "_block", F.pmod(F.xxhash64("node", "set_key"), F.greatest("_blocks", F.lit(1)))
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_blocks", F.lit(1)) - 1))
    pairs = placed.withColumn("_other", other)
    cell = F.xxhash64("component", F.least("_block", "_other"), F.greatest("_block", "_other"))
    return pairs.select("node", "set_key", cell.alias("cell"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents with equal sets form a class and only its smallest id is compared, so copies cost nothing however
    many there are. Classes that share a band of their min-max signature are candidates; all candidates of a family
    are compared exactly (``links_of``) in cells of bounded size. Documents link when 100 * intersection >=
    ``percent`` * union; a pair at ``percent`` shares no band with probability 2e-6 at most (``banding``).

    Defined results: a text without words (NULL, empty) has no shingles and links with nothing. Rows that repeat an
    id are one document: they link alike, also with each other, and what any of their texts links with is linked. A row with a NULL id is only a group of its own
    (``component_id`` NULL, kept). Empty input: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sign = partial(_signatures, percent=percent)
    signed = stored(
        map_arrow(texts, sign, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signatures"
    )
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(filled.groupBy("set_key").agg(F.min("doc_id").alias("node")), "set_classes")
    # One row of each class carries the bands: the one with the smallest id.
    rows = filled.join(classes, "set_key").where("doc_id = node").select("node", "set_key", "n_shingles", "bands")
    banded = rows.select("node", "set_key", "n_shingles", F.explode("bands").alias("_band"))
    bucket = Window.partitionBy("_band")
    ends = F.min("node").over(bucket).alias("_least"), F.max("node").over(bucket).alias("_most")
    members = banded.select("node", "set_key", "n_shingles", *ends).where("_least <> _most").drop("_most").distinct()
    members = stored(members, "band_members")

    cells = stored(_families(members), "cells")
    table = bit_table(cells, "node", ID_BITS)  # ids serve as their own hashes
    sets = map_arrow(texts, _candidate_sets(table), "node long, set_key binary, shingles binary")
    compared = cells.join(sets, ["node", "set_key"]).select("cell", "node", "shingles")
    compared = compared.repartition("cell").sortWithinPartitions("cell")
    links = map_arrow(compared, partial(_compare, percent=percent), "a long, b long")
    same = filled.join(classes, "set_key").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    named = components(links.unionByName(same))
    out = signed.join(named, signed["doc_id"] == named["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = LINK_PERCENT
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: one document of each group of linked ones. Rows that
    repeat an id are one document and stay or go together."""
    found = near_groups(docs, id_col, text_col, percent)
    dropped = stored(found.where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct(), "near_dropped")
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
