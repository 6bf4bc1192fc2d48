"""Article-shaped frames over the given tables.

``documents`` gives text, language and dataset name, ``labels`` the label, ``pages`` the URL. Only this module knows
those tables; the operators work on any dataset with a mapping config.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.operators.ingest import map_articles
from newsgraph.operators.triples import add_record_hashes
from newsgraph.sources.config import MappingConfig
from newsgraph.sources.readers import read_lines, read_parquet
from newsgraph.operators.clean import assemble_records, parse_records
from newsgraph.session import scratch_dir

FIRST_LOAD = "2024-01-01 00:00:00"
SECOND_LOAD = "2024-02-01 00:00:00"
# The three stamps of a raw record.
STAMPS = ("2018-01-25 16:17:44.789555", "2018-02-02 01:19:41.756632", "2018-02-02 01:19:41.756664")
RECORD_STAMPS = ("scraped_at", "inserted_at", "updated_at")

CONFIG = MappingConfig(
    mandatory={"body": "text", "url": "site_url", "label": "type", "title": "title", "file_name": "file_name"},
    supplementary={
        "publication_date": "published",
        "author": "author",
        "language": "language",
        "country_of_origin": "country",
    },
    custom=("n_chars", "page_id", "shares"),
    source="documents",
)

# The same dataset with every supplementary column.
FULL_CONFIG = MappingConfig(
    mandatory=CONFIG.mandatory,
    supplementary={**CONFIG.supplementary, "detailed_news_label": "segment", "classification_date": "classified"},
    custom=CONFIG.custom,
    source="documents",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _label(quality: Column, toxic: Column) -> Column:
    return (
        F.when((quality == 1) & (toxic == 0), "reliable")
        .when((quality == 0) & (toxic == 0), "unreliable")
        .when((quality == 1) & (toxic == 1), "bias")
        .when((quality == 0) & (toxic == 1), "hate")
    )


def _labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", _label(F.col("quality"), F.col("toxic")).alias("type"))
    return rows.join(labels, "doc_id", "left")


def _with_pages(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("site_url"))
    return rows.join(pages, F.col("doc_id") == F.col("page_id"), "left")


def _dataset(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        "site_url",
        "type",
        F.col("source").alias("file_name"),
        F.col("lang").alias("language"),
        "n_chars",
        "page_id",
    )


def raw_articles(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """A source dataset as a scraper would deliver it; author, published, country and shares are absent."""
    texts = documents(spark, sf_dir) if texts is None else texts
    return _dataset(_with_pages(spark, sf_dir, _labelled(spark, sf_dir, texts)))


def articles(spark: SparkSession, sf_dir: str, run_ts: str = FIRST_LOAD) -> DataFrame:
    """The standard article table after one load."""
    accepted, _ = map_articles(raw_articles(spark, sf_dir), CONFIG, run_ts)
    return accepted


def full_articles(spark: SparkSession, sf_dir: str, run_ts: str = FIRST_LOAD) -> DataFrame:
    """The standard article table with author, country, dates and detailed label where a customer has the article's
    number; its first order is the publication, its last one the classification."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    segment = F.initcap("c_mktsegment")
    customers = customers.select(
        F.col("c_custkey").alias("doc_id"),
        F.concat("c_name", F.lit(" of Desk "), segment).alias("author"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("segment"),
    )
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"))
    orders = orders.agg(
        F.date_format(F.min("o_orderdate"), stamp).alias("published"),
        F.date_format(F.max("o_orderdate"), stamp).alias("classified"),
    )
    rows = raw_articles(spark, sf_dir).join(customers, "doc_id", "left").join(orders, "doc_id", "left")
    return map_articles(rows, FULL_CONFIG, run_ts)[0]


def article_loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two loads: all articles before they are labelled, then the articles that got a label."""
    rows = raw_articles(spark, sf_dir)
    first, _ = map_articles(rows.withColumn("type", F.lit(None).cast("string")), CONFIG, FIRST_LOAD)
    second, _ = map_articles(rows.where(F.col("type").isNotNull()), CONFIG, SECOND_LOAD)
    return first, second


def all_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = article_loads(spark, sf_dir)
    return first.unionByName(second)


def news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the cleaned shape, before they are broken into lines."""
    rows = raw_articles(spark, sf_dir)
    host = F.regexp_extract("site_url", "^[a-z]+://([^/?#]+)", 1)
    return rows.select(
        F.col("doc_id").cast("string").alias("idx"),
        F.col("doc_id").cast("string").alias("news_id"),
        F.coalesce(host, F.col("file_name")).alias("domain"),
        F.coalesce("type", F.lit("unknown")).alias("label"),
        F.coalesce("site_url", F.concat_ws("/", "file_name", F.col("doc_id").cast("string"))).alias("url"),
        F.col("text").alias("body"),
        *[F.lit(s).alias(n) for s, n in zip(STAMPS, RECORD_STAMPS)],
        "title",
    )


def web_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the first pipeline: records with their hashes."""
    return add_record_hashes(news_records(spark, sf_dir))


def raw_record_text(records: DataFrame) -> DataFrame:
    """Records as raw CSV text: quotes inside texts are left as they are, texts keep their line breaks."""
    quoted = F.concat(F.lit('"'), "body", F.lit('"'))
    title = F.concat(F.lit('"'), "title", F.lit('"'))
    leading = F.concat_ws(",", "idx", "news_id", "domain", "label", "url", quoted)
    record = F.concat_ws(",", leading, "scraped_at", "inserted_at", "updated_at", title, F.lit('"Unknown","",""'))
    return records.select(record.alias("value"))


def damaged_record_text(records: DataFrame) -> DataFrame:
    """The same text with damage of six kinds by turns: no quotes, a leading field lost, stamps replaced, one stamp lost,
    the end cut off after the stamps, and a title that is a bracketed list. Every seventh record is whole."""
    kind = F.pmod(F.col("idx").cast("long"), F.lit(7))
    body, title = F.concat(F.lit('"'), "body", F.lit('"')), F.concat(F.lit('"'), "title", F.lit('"'))
    fields = ["idx", "news_id", F.when(kind != 2, F.col("domain")), "label", "url"]
    stamps = F.when(kind == 3, "soon").when(kind == 4, F.concat_ws(",", *RECORD_STAMPS[:2]))
    bracketed = F.concat(F.lit('"['), "title", F.lit(']"'))
    title = F.when(kind == 6, bracketed).when(kind != 5, title)
    end = F.when(kind != 5, '"Unknown","",""')
    whole = F.concat_ws(",", *fields, body, stamps.otherwise(F.concat_ws(",", *RECORD_STAMPS)), title, end)
    return records.select(F.when(kind == 1, F.concat_ws(",", *fields, F.lit("lost"))).otherwise(whole).alias("value"))


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of damaged records, read back line by line."""
    path = scratch_dir(spark, "damaged-lines")
    damaged_record_text(news_records(spark, sf_dir)).write.text(path)
    return read_lines(spark, path)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents rendered as broken CSV files and read back line by line."""
    path = scratch_dir(spark, "raw-lines")
    raw_record_text(news_records(spark, sf_dir)).write.text(path)
    return read_lines(spark, path)


def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = parse_records(assemble_records(raw_lines(spark, sf_dir)))
    return accepted
