"""Writers: batched JSON, documents, side-cars, CSV reports, Parquet samples and N-Triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.schema import RECORD_COLUMNS, SIDECAR_COLUMNS


def write_json_batches(df: DataFrame, path: str, batch_size: int) -> None:
    """JSON lines with at most ``batch_size`` records per file. No numbering and no shuffle."""
    df.write.option("maxRecordsPerFile", batch_size).mode("overwrite").json(path)


def batch_objects(df: DataFrame, batch_size: int) -> DataFrame:
    """Batches of at most ``batch_size`` records as one JSON object each, keyed by ``news_id``.

    The batch number is the running record number inside a file block divided by the batch size, so it needs no
    global count and is the same when a task is repeated.
    """
    number = F.floor((F.col("ordinal") - 1) / batch_size).alias("batch")
    record = F.struct("news_id", F.struct(*RECORD_COLUMNS).alias("record"))
    batches = df.groupBy("path", "block", number).agg(F.collect_list(record).alias("records"))
    content = F.to_json(F.map_from_entries("records"), {"ignoreNullFields": "false"})
    return batches.select("path", "block", "batch", content.alias("value"))


def write_batch_objects(df: DataFrame, path: str, batch_size: int) -> None:
    """One file per batch, each holding one object of records."""
    batches = batch_objects(df, batch_size).select("value")
    batches.write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def sidecar_json(df: DataFrame) -> DataFrame:
    """``url_hash`` and the side-car object text ``{url_hash: {...}}`` of every record."""
    content = F.struct(*SIDECAR_COLUMNS)
    value = F.to_json(F.create_map("url_hash", content), {"ignoreNullFields": "false"})
    return df.select("url_hash", value.alias("value"))


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as text, many per file and without a shuffle; each begins with a comment line that holds its name."""
    write_text(documents.select(F.concat(F.lit("# "), "name", F.lit("\n"), "document").alias("value")), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
