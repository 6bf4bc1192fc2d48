"""Profiling reports: counts, distributions, text reuse, reconciliation and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.functions import percent_of_total
from newsgraph.operators.stats import exact_quantiles


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("population_count"))


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key, largest first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def duplicate_keys(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def label_summary(domain_labels: DataFrame, count: str = "url_count") -> DataFrame:
    """Articles per label with their percent of all articles, from counts per domain and label."""
    totals = domain_labels.groupBy("label").agg(F.sum(count).alias("url_count"))
    return percent_of_total(totals, "url_count", "url_count_pct").orderBy(F.desc("url_count"), "label")


def domains_per_label(domain_labels: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, label) pairs per label with their percent; NULL domains are not counted."""
    counts = domain_labels.groupBy("label").agg(F.count(domain).alias("domain_count"))
    return percent_of_total(counts, "domain_count", "domain_count_pct").orderBy(F.desc("domain_count"), "label")


def domain_multi_label(domain_labels: DataFrame, domain: str = "domain", count: str = "n") -> DataFrame:
    """Flag every repeat of a domain in descending-count order; the first sighting is False.

    The first label per domain is a combinable minimum joined back, so a domain with very many labels is not
    sorted in one task.
    """
    place = F.struct(-F.col(count), F.col("label"))
    first = domain_labels.groupBy(F.col(domain).alias("_domain")).agg(F.min(place).alias("_first"))
    joined = domain_labels.join(first, F.col(domain).eqNullSafe(F.col("_domain")))
    flag = ~place.eqNullSafe(F.col("_first"))
    return joined.select(*domain_labels.columns, flag.alias("domain_has_multiple_label"))


def reused_bodies(df: DataFrame, top: int = 50, distinct: bool = True) -> DataFrame:
    """Bodies by the number of URLs that carry them; the report keeps the ``top`` most used."""
    urls = F.count_distinct("url_hash") if distinct else F.count("url_hash")
    counts = df.groupBy("body_hash", "label").agg(urls.alias("url_count"))
    return counts.orderBy(F.desc("url_count"), "body_hash", "label").limit(top)


def cross_domain_bodies(df: DataFrame, top: int | None = 50, least: int = 0) -> DataFrame:
    """Labels per distinct body and domain with ``least`` labels; the report keeps the ``top`` largest, None all."""
    counts = df.groupBy("body_hash", "domain_hash").agg(F.count_distinct("label").alias("label_count"))
    counts = counts.where(F.col("label_count") >= least)
    if top is None:
        return counts
    return counts.orderBy(F.desc("label_count"), "body_hash", "domain_hash").limit(top)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row counts per key in two stores, side by side. Both sides are counted before the join."""
    left_n = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_count"))
    right_n = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_count"))
    status = (
        F.when(F.col("right_count") == 0, "left only")
        .when(F.col("left_count") == 0, "right only")
        .when(F.col("left_count") == F.col("right_count"), "equal")
        .otherwise("different")
    )
    return left_n.join(right_n, key, "full_outer").na.fill(0).withColumn("status", status)


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum("left_count").alias("left_rows"),
        F.sum("right_count").alias("right_rows"),
    )


def describe_columns(df: DataFrame) -> DataFrame:
    """Profile of every column: count, unique, top, freq for texts and all other types as text; mean, std, min, quartiles, max for numbers.

    Values are counted by their sha256, not by their text, so long texts are not shuffled; the most frequent text
    is fetched afterwards by its hash. ``top`` is the smallest hash among equally frequent values. Quartiles are
    exact and computed without gathering a column in one task.
    """
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in df.schema.fields if f.name not in numbers]
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    df = df.withColumns({c: F.base64(c) if c in binary else F.col(f"`{c}`").cast("string") for c in texts})
    parts = []
    if texts:
        parts.append(_describe_texts(df, texts))
    if numbers:
        parts.append(_describe_numbers(df, numbers))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _describe_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    def long(value):
        entries = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
        return df.select(F.inline(entries))

    hashed = long(lambda c: F.sha2(F.col(c), 256))
    counts = hashed.groupBy("column", "value").agg(F.count("value").alias("n"))
    first = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("value").alias("unique"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("freq"),
        first.alias("value"),
    )
    tops = per_column.select("column", "value")
    # One row per column of the table, so its size is bounded by the schema.
    named = (
        long(F.col)
        .withColumn("text", F.col("value"))
        .withColumn("value", F.sha2("text", 256))
        .join(F.broadcast(tops), ["column", "value"])
        .groupBy("column")
        .agg(F.min("text").alias("top"))
    )
    return per_column.join(named, "column", "left").select("column", "count", "unique", "top", "freq")


def _describe_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(F.inline(entries))
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "column", "left")
