"""Readers for the inputs: Parquet, CSV, text lines, batched JSON, file listings and saved query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.schema import RECORD_SCHEMA, SIDECAR_SCHEMA


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet by path or glob."""
    return spark.read.parquet(*paths)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Types are inferred (a second pass over the files) unless a schema is given.

    ``multi_line`` allows line breaks inside quoted values; every file is then read by one task.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
    return reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: file, block (byte offset of the file split) and line order in the block.

    ``line_id`` follows the line order only within one block; blocks of a file are ordered by ``block``.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )


def _explode_objects(df: DataFrame, json_col: Column, key: str, schema: T.StructType) -> DataFrame:
    entries = F.from_json(json_col, T.MapType(T.StringType(), schema))
    exploded = df.select(F.explode(entries).alias("entry_key", "entry"))
    values = [F.col(f"entry.{f.name}").alias(f.name) for f in schema.fields if f.name != key]
    return exploded.select(F.col("entry_key").alias(key), *values)


def read_json_batches(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Batch files that hold one JSON object of objects each, keyed by ``news_id``; one file is one read unit."""
    files = spark.read.text(path, wholetext=True)
    return _explode_objects(files, F.col("value"), "news_id", schema)


def flatten_sidecars(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Side-car objects ``{url_hash: {...}}`` to flat rows with the key as ``url_hash``."""
    return _explode_objects(df, F.col(json_col), "url_hash", SIDECAR_SCHEMA)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Side-car files with one JSON object per line."""
    return flatten_sidecars(spark.read.text(path))


def file_manifest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files under a folder whose path matches a pattern. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike(pattern)).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def bindings_to_table(df: DataFrame, json_col: str, variables: list[str]) -> DataFrame:
    """Saved SPARQL JSON responses to one row per binding with one text column per variable."""
    schema = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
    bindings = F.from_json(F.col(json_col), schema)["results"]["bindings"]
    rows = df.select(F.explode(bindings).alias("binding"))
    return rows.select(*[F.try_element_at("binding", F.lit(v))["value"].alias(v) for v in variables])


def query_table(spark: SparkSession, path: str, view: str, sql: str) -> DataFrame:
    """Result of a SQL query over a stored Parquet table registered under ``view``."""
    spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.sql(sql)
