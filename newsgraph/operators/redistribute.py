"""Dealing rows out evenly by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row of the partition below
MOST_BROADCAST = 4_000_000  # borders of 16 bytes that are sent to every task at most, 64 MB


def redistribute(df: DataFrame, weight: Column, parts: int) -> DataFrame:
    """The same rows in at most ``parts`` partitions of about equal weight, whatever the number of cores.

    Rows are numbered in the order in which they lie. The running total of their weights, made of totals of the source
    partitions and sums inside them, says which partition a row goes to; only numbers and weights are shuffled for that.
    The rows themselves move once. A partition takes the heavier of an equal share and the heaviest row, and one row more
    at most, so none is above twice that. NULL and negative weights count as 0. The rows are written once before, so that
    all passes see the same order. Empty input stays empty.
    """
    own = F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = stored(df.select("*", F.monotonically_increasing_id().alias("_place"), own.alias("_weight")), "weighed")
    part = F.shiftright("_place", _ROW_BITS).alias("_part")
    narrow = rows.select("_place", "_weight", part)
    sums = narrow.groupBy("_part").agg(F.sum("_weight").alias("own"), F.max("_weight").alias("most"))
    sums = stored(sums, "weights")
    total, most, sources = sums.agg(F.sum("own"), F.max("most"), F.count("*")).first()
    if not total:
        return df
    target = max(-(-total // parts), most)

    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per source partition
    offsets = sums.select("_part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    number = F.floor((F.col("offset") + F.col("before")) / target).cast("int")
    numbered = narrow.withColumn("before", before).join(offsets, "_part").select("_part", "_place", number.alias("number"))
    borders = numbered.groupBy("_part", "number").agg(F.min("_place").alias("first"))
    borders = borders.groupBy("_part").agg(F.collect_list(F.struct("first", "number")).alias("_borders"))
    count = total // target + 1
    if sources + count <= MOST_BROADCAST:
        borders = F.broadcast(borders)
    begun = F.filter("_borders", lambda b: b["first"] <= F.col("_place"))
    placed = rows.withColumn("_part", part).join(borders, "_part")
    placed = placed.withColumn("_number", F.array_max(F.transform(begun, lambda b: b["number"])))
    return placed.repartitionById(count, F.col("_number")).select(*df.columns)
