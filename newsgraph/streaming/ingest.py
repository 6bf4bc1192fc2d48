"""Load-once ingestion of dropped files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newsgraph.operators.ingest import map_articles, quarantine
from newsgraph.operators.snapshot import append_articles, load_name
from newsgraph.session import is_file
from newsgraph.sources.config import MappingConfig


def _watched(spark: SparkSession, source: str) -> str:
    """The path that a stream is given for a dataset. A folder is its own base, so partition folders are kept; a single file
    cannot be one and becomes a glob that matches this file only."""
    return f"{source[:-1]}[{source[-1]}]" if is_file(spark, source) else source


def ingest_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    config: MappingConfig,
    table: str,
    checkpoint: str,
    run_ts: str,
    glob: str = "*.parquet",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    max_files_per_batch: int | None = None,
) -> None:
    """Load every file of ``source`` that no earlier run has loaded, then stop. ``source`` is a dataset: the folder of its
    files, whose names ``glob`` selects, or one file.

    The checkpoint assigns each file to one batch. A batch may be repeated after a failure, so it replaces the
    partition of the table that is named by checkpoint and batch instead of appending to it, so several streams fill
    one table; rejected rows go beside the table in
    ``<table>_rejected``. ``prepare`` turns a batch of raw rows into the frame that the config describes.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        accepted, rejected = map_articles(rows, config, run_ts)
        load_id = load_name(checkpoint, f"batch-{batch_id}")
        append_articles(accepted, table, load_id)
        append_articles(quarantine(rejected), f"{table}_rejected", load_id)

    query = (
        reader.parquet(_watched(spark, source))
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
