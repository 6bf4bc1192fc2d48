"""Catalogue of source files: which dataset a file belongs to and which columns it has.

Footers are read in tasks, once per file. Files are then read in groups that share columns and config, so the plan has
as many branches as there are kinds of files, however many files there are. The driver holds one row per file, as
Spark's own file index does.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import package_for_workers
from newsgraph.sources.config import MappingConfig

_PARTITION = "^[^=/]+=[^/]*$"
# The columns of Spark's listing of binary files; contents are not read.
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def list_files(spark: SparkSession, source: str, glob: str = "*.parquet") -> DataFrame:
    """``path`` of every file under a folder or glob, sub-folders included."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob)
    return reader.load(source).select("path")


def with_dataset(files: DataFrame) -> DataFrame:
    """Add ``dataset``, ``base`` and ``partition_columns`` from the path.

    Folders ``name=value`` are partitions of the dataset folder above them. A part file belongs to its folder; any other
    file is a dataset of its own.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    is_partition = F.transform(folders, lambda f: f.rlike(_PARTITION))
    # Partition folders are those at the end without a gap; the first folder of a path is never one.
    plain = F.size(folders) - F.array_position(F.reverse(is_partition), False) + 1
    found = files.select("path", parts.alias("parts"), folders.alias("folders"), plain.cast("int").alias("plain"))
    base = F.array_join(F.slice("folders", 1, F.col("plain")), "/")
    partitioned = F.col("plain") < F.size("folders")
    name = F.element_at("parts", -1)
    in_folder = partitioned | name.startswith("part-")
    keys = F.transform(F.slice("folders", F.col("plain") + 1, F.size("folders")), lambda f: F.substring_index(f, "=", 1))
    return found.select(
        "path",
        F.when(in_folder, F.element_at(F.slice("folders", 1, F.col("plain")), -1)).otherwise(name).alias("dataset"),
        base.alias("base"),
        keys.alias("partition_columns"),
    )


def open_file(path: str, encoded: bool = False) -> pa.NativeFile:
    """A file for random reads inside a task. ``encoded``: special characters of the path are written as %XX."""
    if path.startswith(("file:", "/")):
        local = "/" + path.removeprefix("file:").lstrip("/")
        return pyarrow.fs.LocalFileSystem().open_input_file(unquote(local) if encoded else local)
    system, inside = pyarrow.fs.FileSystem.from_uri(path if encoded else quote(path, safe=":/@?=&"))
    return system.open_input_file(inside)


def fingerprint(schema: pq.ParquetSchema) -> str:
    """Names and types of all columns, whatever their order."""
    columns = [schema.column(i) for i in range(len(schema))]
    lines = [f"{c.path}\t{c.physical_type}\t{c.logical_type}\t{c.max_repetition_level}" for c in columns]
    return sha256("\n".join(sorted(lines)).encode()).hexdigest()


def catalogue(files: DataFrame) -> DataFrame:
    """``path, dataset, base, partition_columns, fingerprint`` per file. Footers are read where the files were listed,
    with ``pyarrow.fs``, which has to know the store."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    found.append(fingerprint(pq.ParquetFile(file).schema))
            yield batch.append_column("fingerprint", pa.array(found, pa.string()))

    package_for_workers(files.sparkSession)
    rows = with_dataset(files)
    fields = "path string, dataset string, base string, partition_columns array<string>, fingerprint string"
    return rows.mapInArrow(read, fields)


@dataclass
class FileGroup:
    """Files of equal columns whose datasets have the same config (None: no config)."""

    paths: list[str]
    dataset: str | None  # the one dataset of partition folders
    base: str | None
    config: MappingConfig | None

    def read(self, spark: SparkSession, dataset_col: str) -> tuple[DataFrame, bool]:
        """All rows with the name of their dataset, and whether they brought that name themselves."""
        reader = spark.read if self.base is None else spark.read.option("basePath", self.base)
        rows = reader.parquet(*self.paths)
        if dataset_col in rows.columns:
            return rows, True
        name = _dataset_of_row() if self.dataset is None else F.lit(self.dataset)
        return rows.select("*", name.alias(dataset_col)), False


def _dataset_of_row() -> Column:
    """The dataset of a row by its file; the metadata column holds an encoded path."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.when(name.startswith("part-"), folder).otherwise(name)


def file_groups(files: DataFrame, configs: Mapping[str, MappingConfig]) -> list[FileGroup]:
    """Groups of files by columns, config and, for partition folders, dataset."""
    groups: dict[tuple, FileGroup] = {}
    for row in catalogue(files).collect():
        config = configs.get(row["dataset"])
        base = row["base"] if row["partition_columns"] else None
        key = (base, tuple(row["partition_columns"]), row["fingerprint"], config and config.to_text())
        if key not in groups:
            groups[key] = FileGroup([], row["dataset"] if base is not None else None, base, config)
        groups[key].paths.append(row["path"])
    for group in groups.values():
        group.paths.sort()
    return [groups[key] for key in sorted(groups, key=str)]
