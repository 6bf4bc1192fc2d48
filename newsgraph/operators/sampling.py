"""Exact-size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.session import stored

_BUCKET_CHARS = 5  # hex characters: at most 16**5 buckets, whatever the table size
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row of the partition below


def number_in_place(df: DataFrame, name: str) -> DataFrame:
    """Number rows from 0 without moving them: rows of a partition are numbered where they are, and the counts of the
    partitions before it are added. The rows are written once, so that both passes see the same ones."""
    rows = stored(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", _ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row per partition
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    numbered = rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + inside)
    return numbered.drop("_part", "_place", "_before")


def _last_of(df: DataFrame, group: Column, n: int) -> tuple[str, int, int] | None:
    """The group (in order) that holds the n-th row, the rows of groups before it, and its own rows."""
    counts = df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("own"))
    upto = F.sum("own").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where(F.col("upto") >= n).orderBy("g").limit(1).collect()
    return (found[0]["g"], found[0]["upto"] - found[0]["own"], found[0]["own"]) if found else None


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer), without replacement, repeatable for a seed.

    The sample is the ``n`` smallest md5 values of seed and key. A first pass over the key column counts rows per
    hash prefix and finds the prefix that holds the n-th row; a second pass counts rows per hash inside this prefix and
    finds the last hash of the sample. Full rows are only filtered against it and do not move. If more rows have the
    last hash than the sample takes, as with repeated keys, they are numbered in place; which of them are taken is
    not defined.
    """
    if n <= 0:
        return df.limit(0)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    prefix = F.left(digest, F.lit(_BUCKET_CHARS))
    bucket = _last_of(df, prefix, n)
    if bucket is None:
        return df
    last, before, own = _last_of(df.where(prefix == bucket[0]), digest, n - bucket[1])
    taken = n - bucket[1] - before
    if taken == own:
        return df.where(digest <= last)
    ties = number_in_place(df.where(digest == last), "_number").where(F.col("_number") < taken).drop("_number")
    return df.where(digest < last).unionByName(ties)
