"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.session import stored

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# What separates words (blank, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_position(docs: DataFrame) -> DataFrame:
    """The same rows with columns named _c0, _c1, ..., so that no name of the user's meets one of an operator's."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Number rows from 0 in a total order without gathering them: range partitions are sorted and numbered on
    their own, and one row per partition gives the offsets. The sorted frame is written once, because two
    evaluations of a range partitioning may cut at different places."""
    inside = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "ranked",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = inside.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_row"))
    return out.drop("_part", "_row", "_offset")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package also when the driver was started from another folder."""
    environment = df.sparkSession.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), _ROOT]))
    return df.mapInArrow(function, schema)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into pieces of about ``limit`` text bytes (at least one row each).

    Yields the rows, the bytes of their texts in one array, and the byte offsets of the texts. NULL is empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            at = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[at[0] : at[-1]], at - at[0]
            first = last
