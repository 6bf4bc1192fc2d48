"""Variable-capacity best-fit packing of documents into training sequences.

Best fit looks at lengths only, and pieces of one length are interchangeable. The packing is therefore planned on
the histogram of lengths, which has at most as many rows as the longest sequence has tokens, whatever the input
size, and the plan speaks of ranges of equal bins. The pieces themselves stay in Spark: each gets its number among
the pieces of its length and finds its bin by joining the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import word_count
from newsgraph.session import stored

CAPACITIES = (512, 1024, 2048, 4096)  # production parameters: permitted sequence lengths, in words
OVERHEAD = 16  # cost of a sequence beside its tokens
_BLOCK = 4096  # slots that share a join key


def plan_bins(
    counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD
) -> list[dict]:
    """Plan best fit, longest first, for ``counts`` pieces of each length.

    A piece goes to the open bin with the least room that is enough; of several with this room, to the one that was
    opened first. If there is none, a bin opens in the capacity
    whose cost per token is least when the bin is filled with pieces of this length that are left (ties: the
    larger one). At the end each bin shrinks to the smallest capacity that holds its contents. Bins with the same
    contents are one range; the result has a row per range and length in it.
    """
    sizes = sorted(set(capacities))
    open_bins: dict[int, list[tuple]] = {}  # room -> heap of (first bin, bins, used, contents, capacity)
    rooms: list[int] = []
    n_bins = 0

    def put(first: int, bins: int, used: int, contents: tuple, capacity: int) -> None:
        if bins:
            room = capacity - used
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            heappush(open_bins[room], (first, bins, used, contents, capacity))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, slot = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins, used, contents, capacity = heappop(open_bins[room])
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                fits = [c for c in sizes if c >= length]
                capacity = min(fits, key=lambda c: ((c + overhead) / (min(c // length, left) * length), -c))
                room, first, used, contents = capacity, n_bins, 0, ()
                bins = max(1, left // (capacity // length))
                n_bins += bins
            each = min(room // length, left)
            filled = min(bins, left // each)
            put(first, filled, used + each * length, contents + ((length, each, slot, used),), capacity)
            slot += filled * each
            left -= filled * each
            # Bins of the range that got nothing yet; what earlier lengths put there starts at later slots.
            rest = tuple((x, k, s + filled * k, o) for x, k, s, o in contents)
            put(first + filled, bins - filled, used, rest, capacity)
    out = []
    for ranges in open_bins.values():
        for first, bins, used, contents, _ in ranges:
            capacity = sizes[bisect_left(sizes, used)]
            out += [
                {
                    "length": length,
                    "slot": slot,
                    "slots": bins * each,
                    "each": each,
                    "bin": first,
                    "offset": offset,
                    "used": used,
                    "capacity": capacity,
                }
                for length, each, slot, offset in contents
            ]
    return out


def pieces_of(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """Cut documents longer than the longest sequence: all pieces but the last are full."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("_size"))
    last = F.greatest(F.ceil(F.col("_size") / longest) - 1, F.lit(0))
    out = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    out = out.withColumn("start", F.col("piece") * longest)
    return out.withColumn("length", F.least(F.lit(longest), F.col("_size") - F.col("start")).cast("int")).drop("_size")


def best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: float = OVERHEAD,
) -> DataFrame:
    """One row per piece of a document: ``doc_id, piece, start, length, bin_id, bin_offset, bin_used, bin_capacity``.

    Lengths are words. ``start`` is the first word of the piece in its document, ``bin_offset`` its place in the
    sequence. Defined results: a document without words (NULL, empty) is one piece of length 0 in no bin (NULL).
    Repeated rows are packed once each; equal pieces may swap places, which changes no row. Empty input: no rows.
    """
    longest = max(capacities)
    pieces = stored(
        pieces_of(docs, id_col, text_col, longest).withColumn("_hash", F.xxhash64("doc_id", "piece")), "pieces"
    )
    spark = docs.sparkSession
    # A length that a third of all pieces have is numbered in shards of some 100,000 pieces, so no task holds it.
    shards = max(1, -(-pieces.count() // 100_000))
    pieces = pieces.withColumn("_shard", F.pmod("_hash", F.lit(shards)))
    counts = stored(pieces.groupBy("length", "_shard").agg(F.count("*").alias("_n")), "piece_counts")
    # At most max(capacities) rows come to the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect() if r[0]}
    plan = plan_bins(histogram, capacities, overhead)
    columns = ("length", "slot", "slots", "each", "bin", "offset", "used", "capacity")
    data = pa.table({c: pa.array([r[c] for r in plan], pa.int64()) for c in columns})
    bins = spark.createDataFrame(data).withColumn("_length", F.col("length").cast("int")).drop("length")
    first, last = F.floor(F.col("slot") / _BLOCK), F.floor((F.col("slot") + F.col("slots") - 1) / _BLOCK)
    bins = bins.withColumn("_block", F.explode(F.sequence(first, last)))

    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_shard").orderBy("_hash", "doc_id", "piece")
    numbered = pieces.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, ["length", "_shard"])
    numbered = numbered.withColumn("_slot", F.col("_before") + F.col("_in"))
    numbered = numbered.withColumn("_at", F.floor(F.col("_slot") / _BLOCK))
    placed = numbered.join(
        bins,
        (F.col("length") == F.col("_length"))
        & (F.col("_at") == F.col("_block"))
        & (F.col("_slot") >= F.col("slot"))
        & (F.col("_slot") < F.col("slot") + F.col("slots")),
        "left",
    )
    inside_range = F.col("_slot") - F.col("slot")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        (F.col("bin") + F.floor(inside_range / F.col("each"))).alias("bin_id"),
        (F.col("offset") + (inside_range % F.col("each")) * F.col("length")).alias("bin_offset"),
        F.col("used").alias("bin_used"),
        F.col("capacity").alias("bin_capacity"),
    )
