"""The batch jobs, end to end."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from newsgraph.operators.clean import assemble_records, dedupe_last_wins, drop_missing_keys, parse_all, split_parsed
from newsgraph.operators.entities import DEFAULT_RULES, rule_entities
from newsgraph.operators.ingest import map_articles, map_mixed_articles, quarantine
from newsgraph.operators.rdf import DEFAULT_NS, TripleStore, ontology, write_triples
from newsgraph.operators.sinks import sidecar_json, write_documents, write_json_batches, write_text
from newsgraph.operators.snapshot import append_articles, latest_articles, latest_snapshot, load_name, read_articles
from newsgraph.operators.triples import (
    add_record_hashes,
    article_documents,
    article_triples,
    entity_documents,
    entity_triples,
    url_triples,
)
from newsgraph.session import scratch, stored
from newsgraph.sources.catalogue import LISTING, file_groups, list_files
from newsgraph.sources.config import MappingConfig, load_configs
from newsgraph.sources.readers import read_lines


def map_files(
    files: DataFrame, configs: Mapping[str, MappingConfig], run_ts: str, dataset_col: str = "file_name"
) -> tuple[DataFrame, DataFrame]:
    """Files of any datasets (one ``path`` per row) -> accepted article rows, and rejected rows as JSON with a reason.

    Every dataset is read with its own columns, partition folders included, and its config is chosen by its name: the
    dataset column of its rows if it has one, else the name of its file or folder. Files of equal columns and config are
    one branch of the plan. As a group is accepted or rejected as a whole unless its rows name their dataset, each of
    its files is read once.
    """
    spark = files.sparkSession
    accepted, rejected = [], []
    for group in file_groups(files, configs):
        rows, named = group.read(spark, dataset_col)
        if named:
            good, bad = map_mixed_articles(rows, configs, run_ts, dataset_col)
        elif group.config is None:
            good, bad = map_mixed_articles(rows, {}, run_ts, dataset_col)
        else:
            good, bad = map_articles(rows, group.config, run_ts)
        accepted.append(good)
        rejected.append(quarantine(bad))
    if not accepted:
        raise FileNotFoundError("no files to ingest")
    return reduce(DataFrame.unionByName, accepted), reduce(DataFrame.unionByName, rejected)


def ingest_dataset(
    spark: SparkSession,
    source: str,
    config_dir: str,
    table: str,
    run_ts: str,
    dataset_col: str = "file_name",
    glob: str = "*.parquet",
) -> None:
    """Parquet files and their YAML configs -> one load of the article table; rejects beside it (see ``map_files``).

    A dataset without config is rejected with its whole rows. The load is named by source and time stamp: running it
    again replaces it and nothing else.
    """
    accepted, rejected = map_files(list_files(spark, source, glob), load_configs(spark, config_dir), run_ts, dataset_col)
    load = load_name(source, re.sub(r"\D+", "-", run_ts))
    append_articles(accepted, table, load)
    append_articles(rejected, f"{table}_rejected", load)


def ingest_stream(
    spark: SparkSession,
    source: str,
    config_dir: str,
    table: str,
    checkpoint: str,
    run_ts: str,
    dataset_col: str = "file_name",
    glob: str = "*.parquet",
    max_files_per_batch: int | None = None,
) -> None:
    """Load every file of ``source`` that no earlier run has loaded, of any number of datasets, then stop.

    The stream carries names of files only, so datasets with different columns and configs share it and its one
    checkpoint. Each batch is resolved to datasets and read like a folder (see ``map_files``); configs are read again
    for each batch. A batch that is repeated after a failure replaces its own partition of the table.
    """
    reader = spark.readStream.format("binaryFile").schema(LISTING)
    reader = reader.options(recursiveFileLookup=True, pathGlobFilter=glob)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def load(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        accepted, rejected = map_files(batch, load_configs(spark, config_dir), run_ts, dataset_col)
        load_id = load_name(checkpoint, f"batch-{batch_id}")
        append_articles(accepted, table, load_id)
        append_articles(rejected, f"{table}_rejected", load_id)

    names = reader.load(source).select("path")  # contents are not read
    query = names.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()


def snapshot_of(spark: SparkSession, table: str, unique: bool = False, late: bool = False) -> DataFrame:
    """The latest snapshot of the article table; ``late`` shuffles row addresses instead of whole rows."""
    if late:
        return latest_articles(spark, table, unique=unique)
    return latest_snapshot(read_articles(spark, table), unique=unique)


def export_graph(spark: SparkSession, table: str, triples_path: str, ns: str = DEFAULT_NS) -> None:
    """Latest snapshot -> triple store, with the ontology once. A later export adds what is new."""
    with scratch(spark):
        graph = article_triples(snapshot_of(spark, table), ns, with_custom=True)
        TripleStore(spark, triples_path).append(graph.unionByName(ontology(spark, "articles", ns)))


def export_documents(spark: SparkSession, table: str, path: str, ns: str = DEFAULT_NS) -> None:
    """Latest snapshot, one row per page -> one document per article."""
    write_documents(article_documents(snapshot_of(spark, table, unique=True), ns), path)


def export_entities(
    spark: SparkSession,
    table: str,
    triples_path: str,
    documents_path: str | None = None,
    rules: dict[str, str] = DEFAULT_RULES,
    ns: str = DEFAULT_NS,
) -> None:
    """Latest snapshot -> entities -> triples, and documents if wanted."""
    with scratch(spark):
        entities = stored(rule_entities(snapshot_of(spark, table), rules), "entities")
        write_triples(entity_triples(entities, ns).unionByName(ontology(spark, "ner", ns)), triples_path)
        if documents_path:
            write_documents(entity_documents(entities, ns), documents_path)


def clean_lines(spark: SparkSession, source: str, json_path: str, rejected_path: str, batch_size: int = 500) -> None:
    """Broken CSV -> JSON batches of accepted records, last one per news id; rejects with their reason."""
    with scratch(spark):
        parsed = stored(parse_all(assemble_records(read_lines(spark, source))), "parsed")
        accepted, rejected = split_parsed(parsed)
        write_json_batches(dedupe_last_wins(accepted), json_path, batch_size)
        rejected.write.mode("overwrite").parquet(rejected_path)


def export_records(records: DataFrame, triples_path: str, sidecar_path: str, ns: str = DEFAULT_NS) -> None:
    """Cleaned records -> URL-centred triples and one side-car object per URL."""
    records = drop_missing_keys(records)  # a record without its key parts has no node and no side-car key
    write_triples(url_triples(records, ns), triples_path)
    last = dedupe_last_wins(add_record_hashes(records), "url_hash", ("updated_at", "idx", "news_id"))
    write_text(sidecar_json(last), sidecar_path)
