"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of its words. A window is a set of shingles; a document contains the window only if it
contains every shingle of it, so one shingle, the rarest, is the necessary prefix of the set. Shingles are ordered by
how often they occur in all documents; documents and windows meet on prefix shingles only. The place of the shingle in
the window fixes where the window would lie in the document (positional bound), and the window must fit between the
ends of the document (length bound). What is left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.arrays import RangeHash, byte_hash, mix
from newsgraph.llm.common import map_arrow, text_chunks
from newsgraph.llm.membership import BitTable, bit_table
from newsgraph.llm.tokens import member_bytes, word_ranges
from newsgraph.session import stored

WIDTH = 10  # words of a window; a shorter item is one window
SHINGLE = 5  # words of a shingle; a shorter window is one shingle
# The table of an item's shingles grows with their number, and is 128 MB at most. Beyond that it lets more shingles
# pass, which costs work and changes no result.
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 30, 16

_MEMBERS = member_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_TOKEN = pa.struct([("hash", pa.int64()), ("offset", pa.int32())])
_PLACE = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("context", pa.string())])


class _Shingles:
    """The words of a chunk of texts and the hashes of their shingles of any size."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text = _LOWER[data].tobytes()
        self.starts, self.ends, self.ranges = word_ranges(data, offsets, _MEMBERS)
        self.hashes = RangeHash(byte_hash(data, lower=True)(self.starts, self.ends), "word")
        self.text_of = np.repeat(np.arange(len(self.ranges) - 1), np.diff(self.ranges))

    def sized(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of this size, and which of them lie inside one text."""
        hashes = mix(self.hashes.sliding(size) + np.uint64(size))
        n = len(hashes)
        return hashes, self.text_of[:n] == self.text_of[size - 1 : size - 1 + n]

    def words(self, first: int, last: int) -> str:
        return " ".join(
            self.text[s:e].decode("utf-8", "replace")
            for s, e in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)
        )


def item_windows(items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, window, n, tokens`` per window of an item: its words, their number, and hash and offset of its
    shingles. An item without words has no window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            found = _Shingles(data, offsets)
            ids = rows.column(0).to_pylist()
            of_size = {k: found.sized(k)[0].view(np.int64) for k in range(1, shingle + 1)}
            out = []
            for item, (first, last) in zip(ids, zip(found.ranges[:-1].tolist(), found.ranges[1:].tolist())):
                n = min(width, last - first)
                size = min(shingle, n)
                for at in range(first, last - n + 1) if n else ():
                    tokens = of_size[size][at : at + n - size + 1].tolist()
                    out.append((item, found.words(at, at + n), n, [{"hash": h, "offset": i} for i, h in enumerate(tokens)]))
            types = (rows.schema.field(0).type, pa.string(), pa.int32(), pa.list_(_TOKEN))
            names = ["item_id", "window", "n", "tokens"]
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    rows = items.select("item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return map_arrow(
        rows, cut, f"item_id {kind}, window string, n int, tokens array<struct<hash: bigint, offset: int>>"
    )


def _table(hashes: DataFrame, n: int) -> BitTable:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    return bit_table(hashes, "hash", bits)


def _token_counts(docs: DataFrame, table: BitTable, sizes: list[int]) -> DataFrame:
    """``hash, times``: how often shingles that are perhaps in the table occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_chunks(batches, "text"):
            found, met = _Shingles(data, offsets), []
            for size in sizes:
                hashes, whole = found.sized(size)
                met.append(hashes[whole & table.perhaps(hashes)])
            values, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *met]), return_counts=True)
            yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(times, pa.int64())], ["hash", "times"])

    found = map_arrow(docs.select("text"), count, "hash long, times long")
    return found.groupBy("hash").agg(F.sum("times").alias("times"))


def _places(docs: DataFrame, table: BitTable, sizes: list[int], width: int) -> DataFrame:
    """``row, doc_id, n_words, places`` per document; a place is a shingle that is perhaps a prefix, with the words
    around it that a window with that shingle could cover."""
    longest = max(sizes, default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text"):
            found, met = _Shingles(data, offsets), []
            for size in sizes:
                hashes, whole = found.sized(size)
                at = np.flatnonzero(whole & table.perhaps(hashes))
                met.append((at, hashes[at].view(np.int64), np.full(len(at), size)))
            if met:
                at, hashes, size = (np.concatenate(x) for x in zip(*met, strict=True))
                order = np.argsort(at, kind="stable")
                at, hashes, size = at[order], hashes[order], size[order]
            else:
                at = hashes = size = np.zeros(0, np.int64)
            own = found.text_of[at]
            first, last = found.ranges[own], found.ranges[own + 1]
            wide = np.where(size == longest, width, size)  # a shorter shingle is a whole window
            begin, end = np.maximum(first, at - (wide - size)), np.minimum(last, at + wide)
            context = [found.words(b, e) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            places = pa.StructArray.from_arrays(
                [
                    pa.array(hashes, pa.int64()),
                    pa.array(at - first, pa.int64()),
                    pa.array(at - begin, pa.int32()),
                    pa.array(context, pa.string()),
                ],
                fields=list(_PLACE),
            )
            borders = pa.array(np.searchsorted(own, np.arange(rows.num_rows + 1)), pa.int32())
            yield pa.record_batch(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(np.diff(found.ranges), pa.int64()),
                    pa.ListArray.from_arrays(borders, places),
                ],
                ["row", "doc_id", "n_words", "places"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    place = "struct<hash: bigint, at: bigint, left: int, context: string>"
    return map_arrow(rows, scan, f"row long, doc_id {kind}, n_words long, places array<{place}>")


def find_windows(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every occurrence of an item window in a document.

    Returns the documents ``row, doc_id, n_words``, the occurrences ``row, start, n, window_id`` (``start`` counts
    words from 0), and the windows ``window_id, window, item_id`` with a row per item that has the window.
    """
    cut = stored(item_windows(items, width, shingle), "item_windows")
    windows = cut.dropDuplicates(["window"]).select("window", "n", "tokens")
    windows = stored(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    tokens = windows.select("window_id", "window", "n", F.explode("tokens").alias("t"))
    tokens = tokens.select("window_id", "window", "n", "t.hash", "t.offset")
    size = F.least(F.col("n"), F.lit(shingle))
    facts = tokens.agg(F.count("*"), F.sort_array(F.collect_set(size))).first()
    sizes = list(facts[1])  # shingle sizes in use, at most SHINGLE numbers

    counts = _token_counts(docs, _table(tokens, facts[0]), sizes)
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "hash", "offset"))
    prefixes = tokens.join(counts, "hash", "left").groupBy("window_id", "window", "n").agg(rarest.alias("p"))
    # The counts are complete: a window whose rarest shingle occurs nowhere cannot occur.
    prefixes = prefixes.where("p.times > 0").select("window_id", "window", "n", "p.hash", "p.offset")
    prefixes = stored(prefixes, "prefixes")

    scanned = stored(_places(docs, _table(prefixes, prefixes.count()), sizes, width), "places")
    places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    words, begin = F.split("context", " "), F.col("left") - F.col("offset")
    met = places.join(prefixes, "hash")
    met = met.where((begin >= 0) & (begin + F.col("n") <= F.size(words)))  # positional and length bounds
    met = met.where(F.array_join(F.slice(words, begin + 1, F.col("n")), " ") == F.col("window"))
    found = met.select("row", (F.col("at") - F.col("offset")).alias("start"), "n", "window_id")
    of_items = cut.select("item_id", "window").distinct().join(windows.select("window", "window_id"), "window")
    return scanned.drop("places"), stored(found, "occurrences"), of_items


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, start, n, window`` for every place where a document holds a window of an item."""
    rows, found, windows = find_windows(docs, items, width)
    found = found.join(windows.select("window_id", "window").distinct(), "window_id")
    return found.join(rows, "row").select("doc_id", "start", "n", "window")


def audit(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Windows of documents with the same set of windows lead to the same items, so items are looked up once per distinct
    set: a window shared by many items and many documents is never multiplied out.

    Defined results: NULL and empty texts have no words and are not contaminated; repeated rows, repeated and NULL ids
    are documents of their own. An item without words marks nothing. An item id that occurs twice is one item; an item
    with NULL id marks words and is not counted. No items: nothing is hit. Empty documents: no rows. Columns other than
    doc_id, item_id and text are not used.
    """
    rows, found, windows = find_windows(docs, items, width, shingle)
    spans = found.groupBy("row", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    reached = F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    spans = spans.withColumn("new", F.greatest(end - reached, F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))

    sets = found.groupBy("row").agg(F.sort_array(F.collect_set("window_id")).alias("windows"))
    sets = stored(sets.withColumn("set", F.sha2(F.array_join("windows", ","), 256)), "window_sets")
    own = sets.groupBy("set").agg(F.first("windows").alias("windows"))
    own = own.select("set", F.explode("windows").alias("window_id")).join(windows, "window_id")
    own = own.groupBy("set").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    own = own.select("set", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    named = sets.select("row", "set").join(own, "set", "left")
    out = rows.join(hit, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
