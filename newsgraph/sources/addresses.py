"""Rows of Parquet files by their address: file and number of the row in it. Joins and shuffles work on keys and
addresses; wide columns are read for the rows that are wanted only."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsgraph.session import package_for_workers, stored
from newsgraph.sources.catalogue import open_file

PIECE_ROWS = 100_000  # neighbouring rows of a file that one task fetches from
# What a task holds of a file, whatever the size of its row groups: decoded rows of about so many bytes, and so many at most
# (values that occur again take less room in the file than decoded), and so many bytes of each column as they lie in the file.
BATCH_BYTES, BATCH_ROWS, BUFFER_BYTES = 8 << 20, 512, 1 << 18
ADDRESS = ("_file", "_row")


def addressed(table: DataFrame) -> DataFrame:
    """A frame read from Parquet with the address of each row as two more columns, ``_file`` and ``_row``."""
    place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return table.select("*", *[p.alias(name) for p, name in zip(place, ADDRESS, strict=True)])


def _streamed(source: pa.NativeFile) -> pq.ParquetFile:
    """A file whose column chunks are read piece by piece, not whole before their first row."""
    return pq.ParquetFile(source, pre_buffer=False, buffer_size=BUFFER_BYTES, coerce_int96_timestamp_unit="us")


def _batch_rows(group: pq.RowGroupMetaData, columns: list[str]) -> int:
    """Rows of a row group that are decoded at once."""
    chunks = [group.column(i) for i in range(group.num_columns)]
    size = sum(c.total_uncompressed_size for c in chunks if c.path_in_schema.split(".")[0] in columns)
    return max(1, min(BATCH_ROWS, BATCH_BYTES * group.num_rows // max(1, size)))


def _wanted(file: pq.ParquetFile, rows: array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows with these ascending numbers. Row groups without any are skipped; others pass in small batches."""
    present = [n for n in schema.names if n in file.schema_arrow.names]
    numbers = np.frombuffer(rows, np.int64)
    first = 0
    for group in range(file.num_row_groups):
        end = first + file.metadata.row_group(group).num_rows
        at = first
        first = end
        low, high = numbers.searchsorted([at, end])
        if low == high:
            continue
        size = _batch_rows(file.metadata.row_group(group), present)
        for batch in file.iter_batches(size, row_groups=[group], columns=present, use_threads=False):
            if at > numbers[high - 1]:
                break
            start, stop = numbers.searchsorted([at, at + batch.num_rows])
            if start < stop:
                part = batch.take(pa.array(numbers[start:stop] - at))
                columns = [
                    part.column(f.name).cast(f.type) if f.name in present else pa.nulls(part.num_rows, f.type) for f in schema
                ]
                yield pa.record_batch(columns, schema)
            at += batch.num_rows


def fetch_rows(addresses: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows at these addresses (columns ``_file``, ``_row``) with the columns of ``schema``; what a file lacks is NULL.

    Addresses are dealt to tasks by file and piece of PIECE_ROWS rows, with an explicit number of tasks, because their own
    bytes say nothing about the rows they stand for. An address that is given twice is fetched twice. The files must be
    those that the addresses were taken from; a table whose files were replaced meanwhile fails.
    """
    spark = addresses.sparkSession
    package_for_workers(spark)
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, array("q")

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                with open_file(name, encoded=True) as source:
                    yield from _wanted(_streamed(source), rows, arrow)

        for batch in batches:
            for own, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    yield from done()
                    name, rows = own, array("q")
                rows.append(row)
        yield from done()

    places = stored(addresses.select(*ADDRESS), "addresses")
    piece = F.floor(F.col("_row") / PIECE_ROWS)
    pieces = places.agg(F.count_distinct("_file", piece)).first()[0]
    dealt = places.repartition(max(1, pieces), "_file", piece).sortWithinPartitions(*ADDRESS)
    return dealt.mapInArrow(read, schema)
