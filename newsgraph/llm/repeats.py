"""What substring dedup and suffix-array dedup share: bringing equal windows of all documents together.

1. Minimisers that occur more than once anywhere are found from their hashes alone (4 bytes each) and kept in a bit
   table of fixed size. A window whose minimiser is unique is unique itself, so its text never travels.
2. The other super-k-mers travel to the bucket of their minimiser as packed strings. Of equal strings in one chunk
   of documents only the earliest travels: the later ones are covered whatever other chunks hold, and are settled
   at once. A passage that every document repeats reaches its bucket as one string per chunk.
3. Minimisers that are frequent in most chunks (their number is bounded by the chunk size) are hot. Their windows are sent one by one to the bucket of the window's own hash, so the contexts of a common line spread evenly.
4. A bucket finds the earliest document of every window; each operator does this by its own method.
5. The covered spans return to their documents. Only texts that may have spans are shuffled for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.arrays import RangeHash, byte_hash, mix, words
from newsgraph.llm.common import map_arrow, text_chunks
from newsgraph.llm.membership import bit_table
from newsgraph.llm.superkmers import runs
from newsgraph.session import stored

TABLE_BITS = 28  # bit table of repeated minimisers: 32 MB whatever the input
_SLICES = 256  # parts of the table, each made by one reducer at a time
_SHORT = 30  # bits of a minimiser's hash that are counted, beside the 8 that name its slice
HOT_TIMES = 8  # a minimiser with so many super-k-mers in a chunk, in more than half of all chunks, is hot
CHUNK_BYTES = 1 << 20  # text that a task works on at a time
BUCKET_BYTES = 2 << 20  # input text per bucket
ID_BITS = 1 << 26


@dataclass
class Sequence:
    """Texts of a chunk as one sequence of units (bytes or words)."""

    hashes: RangeHash
    ranges: np.ndarray  # borders of the texts, in units
    buffer: np.ndarray  # bytes of all units
    starts: np.ndarray  # first byte of each unit, one more at the end
    gap: int  # bytes between units

    def pieces(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        raw = self.buffer.tobytes()
        for a, b in zip(self.starts[first].tolist(), (self.starts[last] - self.gap).tolist(), strict=True):
            yield raw[a:b]


def as_bytes(data: np.ndarray, offsets: np.ndarray) -> Sequence:
    return Sequence(byte_hash(data), offsets, data, np.arange(len(data) + 1), 0)


def as_words(data: np.ndarray, offsets: np.ndarray) -> Sequence:
    """Words joined by one blank, so that equal word sequences are equal strings."""
    first, end, ranges = words(data, offsets)
    lengths = end - first
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(starts[-1], 0x20, np.uint8)
    place = np.repeat(starts[:-1], lengths) + (
        np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    )
    source = np.repeat(first, lengths) + (place - np.repeat(starts[:-1], lengths))
    joined[place] = data[source]
    return Sequence(RangeHash(byte_hash(data)(first, end), "word"), ranges, joined, starts, 1)


@dataclass(frozen=True)
class Windows:
    """How an operator cuts its windows and finds the earliest document of each."""

    cut: Callable[[np.ndarray, np.ndarray], Sequence]
    width: int
    gram: int
    # (pieces, earliest document of each) -> spans (piece, first unit, units, earliest document)
    spans: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    units: Callable[[bytes], int]


def _minimisers(kind: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_chunks(batches, "text", CHUNK_BYTES):
            sequence = kind.cut(data, offsets)
            least = runs(sequence.hashes.sliding(kind.gram), sequence.ranges, kind.width, kind.gram)[3]
            keys, times = np.unique(mix(least), return_counts=True)
            short = ((keys >> np.uint64(64 - 8 - _SHORT)) & np.uint64((1 << _SHORT) - 1)).astype(np.uint32)
            short = (short << np.uint32(2)) | (times > 1) | ((times >= HOT_TIMES).astype(np.uint32) << np.uint32(1))
            cuts = np.searchsorted(keys >> np.uint64(56), np.arange(_SLICES + 1))
            parts = [short[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "keys"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice, one per chunk. The counts of a slice are merged as they come, so memory is bounded
    by the number of different short keys."""

    def merge(keys: np.ndarray, times: np.ndarray, many: np.ndarray, parts: list[np.ndarray]):
        new = np.concatenate(parts)
        key = np.concatenate([keys, new >> np.uint32(2)])
        # Once or more in this chunk; in how many chunks it is frequent.
        count = np.concatenate([times, 1 + (new & np.uint32(1)).astype(np.int64)])
        often = np.concatenate([many, ((new >> np.uint32(1)) & np.uint32(1)).astype(np.int64)])
        out, at = np.unique(key, return_inverse=True)
        return out, np.bincount(at, count).astype(np.int64), np.bincount(at, often).astype(np.int64)

    def result(at: int, keys: np.ndarray, times: np.ndarray, many: np.ndarray, chunks: int) -> pa.RecordBatch:
        bits = np.zeros(1 << (TABLE_BITS - 8), bool)
        bits[(keys >> np.uint32(_SHORT - TABLE_BITS + 8))[times > 1]] = True
        hot = keys[2 * many > chunks].astype(np.int64) | (at << _SHORT)
        return pa.record_batch(
            [
                pa.array([at], pa.int32()),
                pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                pa.array([hot.tobytes()], pa.binary()),
            ],
            ["slice", "bits", "hot"],
        )

    none = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, state, parts, held, chunks = None, none, [], 0, 0
    for batch in batches:
        for slice_no, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if slice_no != at:
                if at is not None:
                    yield result(at, *(merge(*state, parts) if parts else state), chunks)
                at, state, parts, held, chunks = slice_no, none, [], 0, 0
            parts.append(np.frombuffer(keys.as_buffer(), np.uint32))
            held += len(parts[-1])
            chunks += 1
            if held > max(1 << 21, len(state[0])):
                state, parts, held = merge(*state, parts), [], 0
    if at is not None:
        yield result(at, *(merge(*state, parts) if parts else state), chunks)


def _pack(pieces: list[bytes], piece: np.ndarray, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> bytes:
    return b"".join(
        [
            np.array([len(pieces), len(ids)], np.int64).tobytes(),
            np.array([len(p) for p in pieces], np.int64).tobytes(),
            piece.tobytes(),
            ids.tobytes(),
            tags.tobytes(),
            starts.astype(np.int64).tobytes(),
            b"".join(pieces),
        ]
    )


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    lengths = np.frombuffer(blob, np.int64, n, 16)
    arrays = [np.frombuffer(blob, np.int64, m, 16 + 8 * n + 8 * m * i) for i in range(4)]
    first = 16 + 8 * n + 32 * m
    ends = (first + np.cumsum(lengths)).tolist()
    pieces = [blob[a:b] for a, b in zip([first, *ends[:-1]], ends, strict=True)]
    return pieces, *arrays


def _direct(
    text: np.ndarray, first: np.ndarray, units: np.ndarray, sequence: Sequence, rows: pa.RecordBatch
) -> np.ndarray:
    """Merged spans of a chunk as rows of (document, tag, packed span)."""
    order = np.argsort(first, kind="stable")
    text, first, end = text[order], first[order], np.maximum.accumulate((first + units)[order])
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > end[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    text, first, end = text[begin], first[begin], end[np.append(begin[1:] - 1, len(first) - 1)]
    columns = [rows.column(i).to_numpy(zero_copy_only=False)[text].astype(np.int64) for i in (0, 1)]
    return np.stack([*columns, ((first - sequence.ranges[text]) << 32) | (end - first)], 1)


def _super_k_mers(kind: Windows, table, hot, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for rows, data, offsets in text_chunks(batches, "text", CHUNK_BYTES):
            sequence = kind.cut(data, offsets)
            text, first, sizes, least = runs(
                sequence.hashes.sliding(kind.gram), sequence.ranges, kind.width, kind.gram
            )
            key = mix(least)
            at = key >> np.uint64(64 - TABLE_BITS)
            bits = table.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            stay = bits & 1 == 1
            text, first, sizes, key = text[stay], first[stay], sizes[stay], key[stay]
            if not len(key):
                continue
            if len(hot.value):
                place = np.minimum(np.searchsorted(hot.value, key >> np.uint64(56 - _SHORT)), len(hot.value) - 1)
                single = hot.value[place] == key >> np.uint64(56 - _SHORT)
                if single.any():
                    n = sizes[single]
                    window = np.repeat(first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = mix(sequence.hashes(window, window + kind.width) ^ np.uint64(1))
                    text = np.concatenate([text[~single], np.repeat(text[single], n)])
                    first = np.concatenate([first[~single], window])
                    sizes = np.concatenate([sizes[~single], np.ones(len(window), np.int64)])
                    key = np.concatenate([key[~single], own])
            bucket = (key & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            text, first, sizes, bucket = text[order], first[order], sizes[order], bucket[order]
            ids = rows.column(0).to_numpy(zero_copy_only=False)[text].astype(np.int64)
            tags = rows.column(1).to_numpy(zero_copy_only=False)[text].astype(np.int64)
            begin = first - sequence.ranges[text]
            slots: dict[bytes, int] = {}
            found = sequence.pieces(first, first + sizes + kind.width - 1)
            piece = np.fromiter((slots.setdefault(p, len(slots)) for p in found), np.int64, len(first))
            earliest = np.full(len(slots), np.iinfo(np.int64).max)
            np.minimum.at(earliest, piece, ids)
            # What an earlier document of this chunk has as well is settled here; only first occurrences travel.
            later = ids > earliest[piece]
            numbers, blobs = [], []
            if later.any():
                direct = _direct(text[later], first[later], sizes[later] + kind.width - 1, sequence, rows)
                numbers.append(int(bucket[0]))
                blobs.append(b"S" + squeeze.compress(direct.tobytes()))
            piece, ids, tags, begin, bucket = (x[~later] for x in (piece, ids, tags, begin, bucket))
            strings = list(slots)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, place = np.unique(piece[a:b], return_inverse=True)
                blob = _pack([strings[i] for i in own], place, ids[a:b], tags[a:b], begin[a:b])
                numbers.append(int(bucket[a]))
                blobs.append(b"P" + squeeze.compress(blob))
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _bucket_spans(kind: Windows):
    def spans(blobs: list[bytes]) -> pa.RecordBatch:
        open_blob = zstandard.ZstdDecompressor()
        slots: dict[bytes, int] = {}
        parts = []
        for blob in blobs:
            pieces, piece, ids, tags, starts = _unpack(open_blob.decompress(blob))
            own = np.array([slots.setdefault(p, len(slots)) for p in pieces], np.int64)
            parts.append((own[piece], ids, tags, starts))
        piece, ids, tags, starts = (np.concatenate([p[i] for p in parts]) for i in range(4))
        earliest = np.full(len(slots), np.iinfo(np.int64).max)
        np.minimum.at(earliest, piece, ids)
        distinct = list(slots)
        of, first, units, document = kind.spans(distinct, earliest)
        # A whole piece that several documents have is a span as well.
        several = np.flatnonzero(np.bincount(piece[ids > earliest[piece]], minlength=len(distinct)))
        of = np.concatenate([several, of])
        first = np.concatenate([np.zeros(len(several), np.int64), first])
        units = np.concatenate([np.array([kind.units(distinct[i]) for i in several], np.int64), units])
        document = np.concatenate([earliest[several], document])
        order = np.argsort(of, kind="stable")
        of, first, units, document = of[order], first[order], units[order], document[order]
        cuts = np.searchsorted(of, np.arange(len(distinct) + 1))
        n = np.diff(cuts)[piece]
        row = np.repeat(np.arange(len(piece)), n)
        span = np.repeat(cuts[piece] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit = ids[row] > document[span]
        row, span = row[hit], span[hit]
        packed = ((starts[row] + first[span]) << 32) | units[span]
        if len(row):  # one span row per document, tag and place at most
            unique = np.unique(np.stack([ids[row], tags[row], packed]), axis=1)
            return pa.record_batch([pa.array(unique[i]) for i in range(3)], ["doc_id", "tag", "span"])
        return pa.record_batch([pa.array([], pa.int64())] * 3, ["doc_id", "tag", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at and blobs:
                    yield spans(blobs)
                    blobs = []
                at = bucket
                if blob[:1] == b"S":
                    made = np.frombuffer(zstandard.decompress(blob[1:]), np.int64).reshape(-1, 3)
                    yield pa.record_batch([pa.array(made[:, i]) for i in range(3)], ["doc_id", "tag", "span"])
                else:
                    blobs.append(blob[1:])
        if blobs:
            yield spans(blobs)

    return run


def covered(docs: DataFrame, kind: Windows) -> DataFrame:
    """``doc_id, tag, spans`` for documents with a window that also starts in a document with a smaller id.

    ``docs`` has ``doc_id, tag, text``; ``tag`` tells rows with one id apart. A span is first unit << 32 | units.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id IS NOT NULL")  # a row without id is neither earlier nor later than another
    small = map_arrow(named, _minimisers(kind), "slice int, keys binary")
    small = small.repartition(_SLICES, "slice").sortWithinPartitions("slice")
    found = map_arrow(small, _repeated, "slice int, bits binary, hot binary").toArrow()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    part = len(table) // _SLICES
    for slice_no, bits in zip(found["slice"].to_pylist(), found["bits"].to_pylist(), strict=True):
        table[slice_no * part : (slice_no + 1) * part] = np.frombuffer(bits, np.uint8)
    hot = np.sort(np.frombuffer(b"".join(found["hot"].to_pylist()), np.int64)).view(np.uint64)
    size = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = 1 << max(6, (size // BUCKET_BYTES).bit_length())
    context = spark.sparkContext
    packed = map_arrow(
        named, _super_k_mers(kind, context.broadcast(table), context.broadcast(hot), buckets), "bucket long, blob binary"
    )
    packed = packed.repartition("bucket").sortWithinPartitions("bucket")
    spans = map_arrow(packed, _bucket_spans(kind), "doc_id long, tag long, span long")
    return spans.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans"))  # bounded by the document


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First units and ends of the maximal covered ranges."""
    first, end = spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF)
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return first[begin], reach[np.append(begin[1:] - 1, len(first) - 1)]


def apply_spans(docs: DataFrame, kind: Windows, remove: Callable, plain: Callable, results: str) -> DataFrame:
    """Results per input row. ``plain(text)`` makes them for a text without spans, ``remove(text, first, end)`` for
    one with; both return a tuple in the order of the schema text ``results``.

    The first pass reads all texts where they lie and makes the plain results; only texts whose id is perhaps among
    the documents with spans go on to the join.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("tag"), "text"
    )
    spans = stored(covered(docs, kind), "spans")
    table = bit_table(spans, "doc_id", ID_BITS)
    names = ["doc_id", "tag", *[x.split()[0] for x in results.split(", ")]]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in results.split(", ")]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text", CHUNK_BYTES):
            ids = rows.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = table.perhaps(ids.view(np.uint64))
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            made = list(zip(*[plain(t) for t in texts], strict=True))
            columns = [pa.array(c, t) for c, t in zip(made, types, strict=True)]
            on = pa.array([t if h else None for t, h in zip(texts, hit, strict=True)], pa.binary())
            yield pa.record_batch([rows.column(0), rows.column(1), *columns, on], [*names, "_text"])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                first, end = merged(spans.values.to_numpy(zero_copy_only=False))
                made.append(remove(text.as_py(), first, end))
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [
                pa.array([], t) for t in types
            ]
            yield pa.record_batch([*batch.columns[2:4], *columns], names)

    schema = f"doc_id long, tag long, {results}"
    read = map_arrow(docs, first_pass, f"{schema}, _text binary")
    joined = read.join(spans.withColumnRenamed("tag", "_tag").withColumnRenamed("doc_id", "_id"),
                       (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    joined = stored(joined.drop("_id", "_tag").withColumn("_text", F.when(F.col("spans").isNotNull(), F.col("_text"))), "texts")
    changed = joined.where("spans IS NOT NULL").select("_text", "spans", "doc_id", "tag")
    same = joined.where("spans IS NULL").select(*names)
    return same.unionByName(map_arrow(changed, second_pass, schema)).drop("tag")
