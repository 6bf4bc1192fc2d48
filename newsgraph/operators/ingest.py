"""Mapping of source datasets onto the standard article table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions import NULL_TEXT, null_text, sha256_hex
from newsgraph.schema import (
    ARTICLE_COLUMNS,
    HASHED_COLUMNS,
    MANDATORY_COLUMNS,
    SUPPLEMENTARY_COLUMNS,
)
from newsgraph.sources.config import MappingConfig


def add_key_hashes(df: DataFrame) -> DataFrame:
    """sha256 of the five key columns and ``article_id`` = title hash followed by body hash."""
    hashes = {f"{c}_hash": sha256_hex(F.col(c)) for c in HASHED_COLUMNS}
    return df.withColumns(hashes).withColumn("article_id", F.concat("title_hash", "body_hash"))


def _source(df: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name in df.columns else None


def _standard_value(df: DataFrame, config: MappingConfig, standard: str) -> Column:
    source = _source(df, config.column_for(standard))
    return F.lit(NULL_TEXT) if source is None else null_text(source)


def _custom_json(df: DataFrame, config: MappingConfig) -> Column:
    """JSON object text: an absent column is the text 'null', a present NULL stays JSON null."""
    fields = [(F.col(f"`{c}`") if c in df.columns else F.lit(NULL_TEXT)).alias(c) for c in config.custom]
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _reject_reason(df: DataFrame, config: MappingConfig) -> Column:
    absent = [c for c in MANDATORY_COLUMNS if config.column_for(c) not in df.columns]
    reason = "missing mandatory column: " + ", ".join(absent) if absent else None
    return F.lit(reason).cast("string")


def _mapped_columns(df: DataFrame, config: MappingConfig) -> dict[str, Column]:
    columns = {c: _standard_value(df, config, c) for c in [*MANDATORY_COLUMNS, *SUPPLEMENTARY_COLUMNS]}
    columns["custom_columns"] = _custom_json(df, config)
    columns["reject_reason"] = _reject_reason(df, config)
    return columns


def _split(df: DataFrame, columns: dict[str, Column], run_ts: str) -> tuple[DataFrame, DataFrame]:
    reason = columns["reject_reason"]
    standard = [col.alias(name) for name, col in columns.items() if name != "reject_reason"]
    accepted = df.where(reason.isNull()).select(F.lit(run_ts).cast("timestamp").alias("etl_timestamp"), *standard)
    rejected = df.where(reason.isNotNull()).select("*", reason.alias("reject_reason"))
    return add_key_hashes(accepted).select(*ARTICLE_COLUMNS), rejected


def map_articles(df: DataFrame, config: MappingConfig, run_ts: str) -> tuple[DataFrame, DataFrame]:
    """Map one dataset; returns (accepted article rows, rejected source rows with ``reject_reason``).

    The config is resolved on the driver into one projection, so the scan reads only the listed columns.
    ``run_ts`` is the one load time of this run.
    """
    return _split(df, _mapped_columns(df, config), run_ts)


def map_mixed_articles(
    df: DataFrame, configs: Mapping[str, MappingConfig], run_ts: str, dataset_col: str = "file_name"
) -> tuple[DataFrame, DataFrame]:
    """Map a frame that mixes several datasets, choosing each row's config by its dataset name.

    Datasets that share a config share one CASE branch, so the frame is scanned once and nothing is joined.
    Rows of a dataset without config are rejected.
    """
    groups: list[tuple[MappingConfig, list[str]]] = []
    for name, config in configs.items():
        for known, members in groups:
            if known == config:
                members.append(name)
                break
        else:
            groups.append((config, [name]))

    branches = [(F.col(dataset_col).isin(members), _mapped_columns(df, config)) for config, members in groups]

    def choose(column: str, default: Column) -> Column:
        if column in ARTICLE_COLUMNS and len({config.column_for(column) for config, _ in groups}) == 1:
            if column != "custom_columns" or len({config.custom for config, _ in groups}) == 1:
                return branches[0][1][column]
        chosen = None
        for condition, cols in branches:
            chosen = F.when(condition, cols[column]) if chosen is None else chosen.when(condition, cols[column])
        return default if chosen is None else chosen.otherwise(default)

    names = [*MANDATORY_COLUMNS, *SUPPLEMENTARY_COLUMNS, "custom_columns"]
    columns = {name: choose(name, F.lit(NULL_TEXT)) for name in names}
    columns["reject_reason"] = choose("reject_reason", F.lit("no mapping config"))
    return _split(df, columns, run_ts)


def drop_empty_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not NULL."""
    return df.where(F.col(column).isNotNull())


def row_counts_before_after(df: DataFrame, *columns: str) -> DataFrame:
    """Row counts before and after ``drop_empty_text`` on each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n_before"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_after")) for c in columns])
    return counts.select("n_before", F.inline(entries))


def quarantine(rejected: DataFrame) -> DataFrame:
    """Rejected source rows in one shape for all datasets: the reason and the row as JSON."""
    row = F.struct(*[c for c in rejected.columns if c != "reject_reason"])
    return rejected.select("reject_reason", F.to_json(row).alias("row"))


def with_parsed_dates(df: DataFrame) -> DataFrame:
    """Timestamps beside the date texts of the article table; NULL when a text is not a date."""
    return df.withColumns(
        {
            "publication_ts": F.try_to_timestamp("publication_date"),
            "classification_ts": F.try_to_timestamp("classification_date"),
        }
    )
