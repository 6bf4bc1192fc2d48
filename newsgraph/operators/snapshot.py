"""The append-only article table and its latest snapshot."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.schema import ARTICLE_COLUMNS, ARTICLE_SCHEMA
from newsgraph.sources.addresses import ADDRESS, addressed, fetch_rows

SNAPSHOT_KEYS = ("article_id", "url")


def load_name(origin: str, run: str) -> str:
    """Name of a load: what makes it, and which of its runs. Two sources with one stamp are two loads."""
    return f"{run}-{sha256(origin.encode()).hexdigest()[:16]}"


def append_articles(df: DataFrame, path: str, load_id: str) -> None:
    """Add one load to the article table, which is partitioned by load. Repeating a load replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/load_id={load_id}")


def replace_articles(df: DataFrame, path: str, load_id: str) -> None:
    """Replace the whole table by one load."""
    df.withColumn("load_id", F.lit(load_id)).write.mode("overwrite").partitionBy("load_id").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The article table with its standard columns, all loads."""
    return spark.read.schema(ARTICLE_SCHEMA).parquet(path).select(*ARTICLE_COLUMNS)


def latest_snapshot(
    df: DataFrame,
    keys: tuple[str, ...] = SNAPSHOT_KEYS,
    ts: str = "etl_timestamp",
    unique: bool = False,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Rows with the latest ``ts`` of their key.

    By default ties survive and NULL keys drop: maximum per key, equi-joined back. The maximum is combined before
    its shuffle and has one row per key, so a key that holds a large share of the rows is hot on one join side
    only, which the adaptive skew join splits.

    ``unique=True`` keeps one row per key, ties broken by ``tiebreak`` (all other columns unless given, so only equal
    rows are left): row number 1, which Spark limits per group before the shuffle, so a hot key sends at most one
    row per task.
    """
    if unique:
        others = tiebreak or [c for c in df.columns if c not in (*keys, ts)]
        order = [F.col(ts).desc(), *[F.col(c).asc_nulls_last() for c in others]]
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        known = df.dropna(subset=[*keys, ts])
        return known.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    latest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(latest, [*keys, ts], "inner").select(*df.columns)


def latest_addresses(
    table: DataFrame,
    keys: tuple[str, ...] = SNAPSHOT_KEYS,
    ts: str = "etl_timestamp",
    unique: bool = False,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Addresses of the rows that ``latest_snapshot`` keeps: only keys, stamps, tie columns and addresses are shuffled.

    Without ``tiebreak``, rows of one key and stamp are told apart by a digest of the whole row, taken in the scan, so
    the choice depends on content only; equal rows are told apart by their address.
    """
    others = [c for c in table.columns if c not in (*keys, ts)]
    ties = tiebreak if unique else ()
    digest = []
    if unique and not tiebreak:
        digest = [F.sha2(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}), 256).alias("_digest")]
        ties = ("_digest",)
    narrow = addressed(table).select(*keys, ts, *ADDRESS, *(tiebreak if unique else ()), *digest)
    found = latest_snapshot(narrow, keys, ts, unique, (*ties, *ADDRESS))
    return found.select(*ADDRESS)


def latest_articles(
    spark: SparkSession, path: str, unique: bool = False, tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """The latest snapshot of the stored article table, wide columns fetched by row address: bodies are read for the
    winners only and are in no shuffle."""
    found = latest_addresses(read_articles(spark, path), unique=unique, tiebreak=tiebreak)
    return fetch_rows(found, ARTICLE_SCHEMA)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with a given key value; the equality is pushed to the scan."""
    return df.where(F.col(column) == value)
