"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.functions import (
    decode_json_map,
    elapsed_seconds,
    guess_type,
    iri_quote,
    prefixed_md5,
    sha256_hex,
    strip_namespace,
    webpage_id,
)
from newsgraph.operators import clean, entities, ingest, patterns, profile, rdf, sampling, sinks, snapshot, stats
from newsgraph.operators import triples as graph
from newsgraph.operators.redistribute import redistribute
from newsgraph.plans import jobs, tables
from newsgraph.plans.tables import CONFIG, FIRST_LOAD, table
from newsgraph.schema import ARTICLE_COLUMNS, ENTITY_COLUMNS, RECORD_COLUMNS, SIDECAR_COLUMNS
from newsgraph.session import scratch_dir, stored, write_small_file
from newsgraph.sources import config as mapping
from newsgraph.sources import documents as named
from newsgraph.sources import readers
from newsgraph.streaming.ingest import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NS = rdf.DEFAULT_NS
BATCH_SIZE = 500
SAMPLE_SIZE = 500


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _stamped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[stamp(c) if c == "etl_timestamp" else c for c in columns])


# --- ingestion ------------------------------------------------------------------------------------------------


@query
def ingest_standard_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(tables.articles(spark, sf_dir), ARTICLE_COLUMNS)


@query
def ingest_custom_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom = decode_json_map(F.col("custom_columns"))
    return tables.articles(spark, sf_dir).select(
        "article_id",
        "custom_columns",
        custom["n_chars"].cast("bigint").alias("n_chars"),
        custom["page_id"].cast("bigint").alias("page_id"),
        custom["shares"].alias("shares"),
    )


@query
def ingest_key_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = webpage_id(F.col("article_id"), F.col("url_hash"))
    hashes = ["body_hash", "url_hash", "title_hash", "file_name_hash", "author_hash"]
    return tables.articles(spark, sf_dir).select(
        "article_id", *hashes, page.alias("webpage_id"), sha256_hex(page).alias("document_name")
    )


def _mixed_configs() -> dict[str, mapping.MappingConfig]:
    """Ten datasets with the common config, eight with another, one with a missing label, and one with none."""
    common = {k: v for k, v in CONFIG.supplementary.items() if k not in ("language", "country_of_origin")}
    other = mapping.MappingConfig(CONFIG.mandatory, {**common, "country_of_origin": "language"}, ("n_chars",))
    broken = mapping.MappingConfig({**CONFIG.mandatory, "label": "category"}, CONFIG.supplementary)
    configs = {f"src{i}": CONFIG for i in range(10)}
    configs.update({f"src{i}": other for i in range(10, 18)})
    configs["src18"] = broken
    return configs


@query
def ingest_multi_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = ingest.map_mixed_articles(tables.raw_articles(spark, sf_dir), _mixed_configs(), FIRST_LOAD)
    return accepted.select("article_id", "url", "file_name", "language", "country_of_origin", "custom_columns")


@query
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = ingest.map_mixed_articles(tables.raw_articles(spark, sf_dir), _mixed_configs(), FIRST_LOAD)
    return rejected.select("doc_id", "file_name", "reject_reason")


@query
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.schema_contract(tables.raw_articles(spark, sf_dir), CONFIG)


@query
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "incremental")
    schema = table(spark, sf_dir, "documents").schema
    for run_ts in (FIRST_LOAD, tables.SECOND_LOAD):  # the second run finds nothing new
        ingest_new_files(
            spark,
            source=f"{sf_dir}/documents.parquet",  # a file or a folder of files
            schema=schema,
            config=CONFIG,
            table=f"{out}/articles",
            checkpoint=f"{out}/checkpoint",
            run_ts=run_ts,
            glob="*",
            prepare=lambda batch: tables.raw_articles(spark, sf_dir, batch),
        )
    return _stamped(snapshot.read_articles(spark, f"{out}/articles"), ARTICLE_COLUMNS)


PAGES_CONFIG = mapping.MappingConfig(
    {"body": "html", "url": "url", "label": "site", "title": "url", "file_name": "file_name"}, source="pages"
)
DOCUMENTS_CONFIG = mapping.MappingConfig(CONFIG.mandatory, {"language": "language"}, ("n_chars",), "documents")


def _page_dataset(pages: DataFrame) -> DataFrame:
    return pages.select("url", "html", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("site"))


@query
def ingest_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of three datasets with different columns: one with partition folders, one of 500 files, and one without
    a config, which is kept as whole rejected rows."""
    out = scratch_dir(spark, "folder")
    documents = tables.raw_articles(spark, sf_dir).drop("file_name", "doc_id")
    documents.write.partitionBy("language").parquet(f"{out}/in/documents.parquet")
    _page_dataset(table(spark, sf_dir, "pages")).repartition(500).write.parquet(f"{out}/in/pages.parquet")
    table(spark, sf_dir, "benchmark").write.parquet(f"{out}/in/benchmark.parquet")
    for name, config in (("documents", DOCUMENTS_CONFIG), ("pages", PAGES_CONFIG)):
        write_small_file(spark, f"{out}/configs/{name}.parquet.yml", config.to_text())
    jobs.ingest_dataset(spark, f"{out}/in/*", f"{out}/configs", f"{out}/articles", FIRST_LOAD)
    columns = ["file_name", "url", "label", "title", "language", "body_hash", "custom_columns"]
    accepted = snapshot.read_articles(spark, f"{out}/articles").select(*columns)
    rejected = spark.read.parquet(f"{out}/articles_rejected").select("reject_reason", "row")
    return accepted.unionByName(rejected, allowMissingColumns=True)


@query
def ingest_dropped_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream over three datasets dropped in two steps: two with configs, the later one partitioned, one without."""
    out = scratch_dir(spark, "dropped")
    for name, config in (("documents", DOCUMENTS_CONFIG), ("pages", PAGES_CONFIG)):
        write_small_file(spark, f"{out}/configs/{name}.parquet.yml", config.to_text())
    table(spark, sf_dir, "benchmark").write.parquet(f"{out}/in/benchmark.parquet")
    _page_dataset(table(spark, sf_dir, "pages")).write.parquet(f"{out}/in/pages.parquet")
    arguments = (f"{out}/in", f"{out}/configs", f"{out}/articles", f"{out}/checkpoint")
    jobs.ingest_stream(spark, *arguments, FIRST_LOAD)
    documents = tables.raw_articles(spark, sf_dir).drop("file_name", "doc_id")
    documents.write.partitionBy("language").parquet(f"{out}/in/documents.parquet")
    for run_ts in (tables.SECOND_LOAD, "2024-03-01 00:00:00"):  # the last run finds nothing new
        jobs.ingest_stream(spark, *arguments, run_ts, max_files_per_batch=3)
    columns = ["etl_timestamp", "file_name", "url", "label", "title", "language", "body_hash", "custom_columns"]
    accepted = _stamped(snapshot.read_articles(spark, f"{out}/articles").select(*columns), columns)
    rejected = spark.read.parquet(f"{out}/articles_rejected").select("reject_reason", "row")
    return accepted.unionByName(rejected, allowMissingColumns=True)


@query
def ingest_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of different datasets, each with its own checkpoint, that fill one article table."""
    out = scratch_dir(spark, "two-streams")
    streams = {
        "documents": (CONFIG, lambda batch: tables.raw_articles(spark, sf_dir, batch)),
        "pages": (PAGES_CONFIG, lambda batch: _page_dataset(batch).withColumn("file_name", F.lit("pages"))),
    }
    for name, (config, prepare) in streams.items():
        ingest_new_files(
            spark,
            source=f"{sf_dir}/{name}.parquet",  # a file or a folder of files
            schema=table(spark, sf_dir, name).schema,
            config=config,
            table=f"{out}/articles",
            checkpoint=f"{out}/checkpoint-{name}",
            run_ts=FIRST_LOAD,
            glob="*",
            prepare=prepare,
        )
    rows = snapshot.read_articles(spark, f"{out}/articles")
    return rows.select("file_name", "url", "label", "title", "language", "body_hash")


@query
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files of the documents, listed by pattern and reconciled with the records read from them."""
    path = scratch_dir(spark, "batches")
    sinks.write_json_batches(tables.documents(spark, sf_dir), path, BATCH_SIZE)
    listed = readers.file_manifest(spark, path, r"/part-[^/]+\.json$").select("file_name")
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"))
    found = profile.reconcile(listed, read, "file_name")
    return found.agg(
        F.sum("right_count").alias("n_records"),
        F.count_if(F.col("left_count") != 1).alias("n_unlisted"),
        F.count_if(F.col("right_count") > BATCH_SIZE).alias("n_too_large"),
    )


@query
def drop_empty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.row_counts_before_after(tables.raw_articles(spark, sf_dir), "text", "type", "site_url")


# --- snapshots ------------------------------------------------------------------------------------------------


@query
def latest_snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = snapshot.latest_snapshot(tables.all_loads(spark, sf_dir))
    return _stamped(latest, ["article_id", "url", "label", "file_name", "etl_timestamp"])


@query
def latest_snapshot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.all_loads(spark, sf_dir)
    latest = snapshot.latest_snapshot(rows, unique=True, tiebreak=("label", "file_name", "custom_columns"))
    return _stamped(latest, ["article_id", "url", "label", "file_name", "custom_columns", "etl_timestamp"])


def _stored_loads(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "articles")
    for number, load in enumerate(tables.article_loads(spark, sf_dir)):
        snapshot.append_articles(load, path, f"load-{number}")
    return path


@query
def latest_snapshot_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties kept, rows fetched by address from a stored article table of two loads, bodies too."""
    latest = snapshot.latest_articles(spark, _stored_loads(spark, sf_dir))
    return _stamped(latest, ["article_id", "url", "label", "file_name", "etl_timestamp", "body"])


@query
def latest_snapshot_late_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_loads(spark, sf_dir)
    latest = snapshot.latest_articles(spark, path, unique=True, tiebreak=("label", "file_name", "custom_columns"))
    return _stamped(latest, ["article_id", "url", "label", "file_name", "custom_columns", "etl_timestamp"])


SNAPSHOT_SQL = """
SELECT * FROM article_table LEFT SEMI JOIN (
  SELECT article_id, url, max(etl_timestamp) AS etl_timestamp FROM article_table GROUP BY ALL
) USING (article_id, url, etl_timestamp)
"""


@query
def append_then_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "article-table")
    first, second = tables.article_loads(spark, sf_dir)
    snapshot.replace_articles(first, path, "1")
    snapshot.append_articles(second, path, "2")
    latest = readers.query_table(spark, path, "article_table", SNAPSHOT_SQL)
    return latest.groupBy(stamp("etl_timestamp"), "label").agg(F.count(F.lit(1)).alias("n_articles"))


# --- cleaning -------------------------------------------------------------------------------------------------


@query
def clean_record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.assemble_records(tables.raw_lines(spark, sf_dir)).select("record")


@query
def clean_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cleaned_records(spark, sf_dir).select(*RECORD_COLUMNS)


@query
def clean_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.reject_counts(clean.assemble_records(tables.raw_lines(spark, sf_dir)))


@query
def clean_damaged_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of records with every kind of damage."""
    return clean.reject_counts(clean.assemble_records(tables.damaged_lines(spark, sf_dir)))


@query
def clean_damaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged records that are rejected, whole and with their reason."""
    _, rejected = clean.parse_records(clean.assemble_records(tables.damaged_lines(spark, sf_dir)))
    return rejected.select("record", "reject_reason")


@query
def clean_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles published again under the same headline: the one with the highest index stays."""
    records = tables.news_records(spark, sf_dir).withColumns(
        {"news_id": F.md5("title"), "place": F.col("idx").cast("bigint")}
    )
    return clean.dedupe_last_wins(records, "news_id", ("place",)).select(*RECORD_COLUMNS)


@query
def key_fields_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("site_url", "^[a-z]+://([^/?#]+)", 1)
    rows = tables.raw_articles(spark, sf_dir).select(
        "doc_id", F.col("site_url").alias("url"), host.alias("domain"), F.col("type").alias("label"),
        F.col("text").alias("body"),
    )
    return clean.drop_missing_keys(rows).select("doc_id", "url", "domain", "label")


@query
def json_batch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "json-batches")
    last = clean.dedupe_last_wins(tables.cleaned_records(spark, sf_dir))
    sinks.write_batch_objects(last, path, BATCH_SIZE)
    return readers.read_json_batches(spark, path)


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.web_articles(spark, sf_dir).withColumn("place", F.col("idx").cast("bigint"))
    return sinks.sidecar_json(clean.dedupe_last_wins(rows, "url_hash", ("place",)))


@query
def json_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sidecars(spark, sf_dir)


@query
def json_sidecar_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "sidecars")
    sinks.write_text(_sidecars(spark, sf_dir), path)
    return readers.read_sidecars(spark, path).select("url_hash", *SIDECAR_COLUMNS)


# --- functions ------------------------------------------------------------------------------------------------


@query
def fn_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return tables.documents(spark, sf_dir).select(
        "doc_id",
        sha256_hex(text).alias("sha256"),
        F.md5(text).alias("md5"),
        prefixed_md5("body_", text).alias("prefixed"),
    )


@query
def fn_iri_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select(
        "doc_id", iri_quote(F.col("text")).alias("quoted"), iri_quote(F.col("source")).alias("quoted_source")
    )


@query
def fn_type_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tables.documents(spark, sf_dir).select(F.explode(F.split("text", "[ \n]+")).alias("token"))
    guess = F.coalesce(guess_type(F.col("token")), F.lit("none"))
    return tokens.groupBy(guess.alias("guess")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_distinct")
    )


@query
def fn_namespace_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_namespace(F.col("url")).alias("stripped"))


# --- profiling ------------------------------------------------------------------------------------------------


@query
def profile_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_count(table(spark, sf_dir, "documents"))


@query
def duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_keys(tables.all_loads(spark, sf_dir), "url", "url_count")


@query
def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.web_articles(spark, sf_dir).select("url_hash").distinct()


@query
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.web_articles(spark, sf_dir).select("url_hash", "url", "domain", "label").orderBy("url_hash").limit(10)


@query
def lookup_by_body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles that carry the most re-used text."""
    rows = tables.web_articles(spark, sf_dir)
    counts = rows.groupBy("body_hash").agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.orderBy(F.desc("n"), "body_hash").limit(1).select("body_hash").scalar()
    return snapshot.lookup(rows, "body_hash", wanted).select("news_id", "url", "domain", "label", "body_hash", "body")


@query
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tables.raw_articles(spark, sf_dir).where(F.col("type").isNotNull())
    return profile.count_by(labelled, "type", name="n_articles")


def _domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.web_articles(spark, sf_dir)
    return rows.groupBy("domain_hash", "label").agg(F.count(F.lit(1)).alias("n_articles"))


@query
def domain_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.count_by(tables.web_articles(spark, sf_dir), "domain_hash", "label", name="n_articles")


@query
def domain_multi_label_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.domain_multi_label(_domain_labels(spark, sf_dir), "domain_hash", "n_articles")


@query
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "label-summary")
    sinks.write_csv(profile.label_summary(_domain_labels(spark, sf_dir), "n_articles"), path)
    saved = readers.read_csv(spark, path, "label string, url_count bigint, url_count_pct double")
    return saved.withColumn("url_count_pct", F.round("url_count_pct", 6))


@query
def domains_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = profile.domains_per_label(_domain_labels(spark, sf_dir), "domain_hash")
    return counts.withColumn("domain_count_pct", F.round("domain_count_pct", 6))


@query
def reused_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.reused_bodies(tables.web_articles(spark, sf_dir)).where("url_count >= 2")


@query
def reused_bodies_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.reused_bodies(tables.web_articles(spark, sf_dir), distinct=False)


@query
def cross_domain_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cross_domain_bodies(tables.web_articles(spark, sf_dir))


@query
def cross_labelled_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that one domain has under more than one label."""
    return profile.cross_domain_bodies(tables.web_articles(spark, sf_dir), least=2, top=None)


@query
def reconcile_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the append-only table against publications in the graph of the labelled articles."""
    page = webpage_id(F.col("article_id"), F.col("url_hash"))
    first, second = tables.article_loads(spark, sf_dir)
    stored = first.select(page.alias("webpage"))
    types = [("?webpage", rdf.RDF_TYPE, NS + "publication")]
    publications = patterns.match_pattern(graph.article_triples(second), types, ["?webpage"])
    linked = publications.select(strip_namespace(F.col("webpage")).alias("webpage"))
    return profile.reconcile_summary(profile.reconcile(stored, linked, "webpage"))


@query
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profile.describe_columns(tables.raw_articles(spark, sf_dir))
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return described.withColumns({c: F.round(c, 4) for c in numbers})


# --- graphs ---------------------------------------------------------------------------------------------------


@query
def triples_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.article_triples(tables.articles(spark, sf_dir))


@query
def triples_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with authors, countries and dates, which most articles of the other queries lack."""
    return graph.article_triples(tables.full_articles(spark, sf_dir))


@query
def triples_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.custom_triples(tables.articles(spark, sf_dir))


@query
def triples_url_centric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.url_triples(tables.news_records(spark, sf_dir), style="hashed")


@query
def triples_url_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.url_triples(tables.news_records(spark, sf_dir), style="raw")


@query
def triples_url_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.url_triples(tables.news_records(spark, sf_dir), style="untyped")


@query
def triples_news_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.url_triples(tables.news_records(spark, sf_dir), style="content")


@query
def triples_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_triples(entities.rule_entities(tables.articles(spark, sf_dir)))


@query
def triples_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = tables.article_loads(spark, sf_dir)
    merged = rdf.merge_triples(graph.article_triples(first), graph.article_triples(second))
    return merged.groupBy("p", "o_kind").agg(F.count(F.lit(1)).alias("n_triples"))


@query
def triples_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph into which an overlapping graph is imported twice: the second time nothing is new."""
    path = scratch_dir(spark, "import")
    first, second = tables.article_loads(spark, sf_dir)
    store = rdf.TripleStore(spark, path, buckets=8)
    for load in (first, second, second):
        store.append(graph.article_triples(load))
    return store.read()


@query
def records_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored record batches, some without page or label -> complete records -> URL-centred triples."""
    path = scratch_dir(spark, "record-batches")
    given = tables.raw_articles(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("idx"), F.col("site_url").alias("url"), F.col("type").alias("label")
    )
    number = F.col("idx").cast("bigint")
    place = {
        "path": F.lit("documents"),
        "block": F.floor(number / BATCH_SIZE),
        "ordinal": F.pmod(number, F.lit(BATCH_SIZE)) + 1,
    }
    records = tables.news_records(spark, sf_dir).drop("url", "label").join(given, "idx")
    sinks.write_batch_objects(records.withColumns(place), path, BATCH_SIZE)
    return graph.url_triples(clean.drop_missing_keys(readers.read_json_batches(spark, path)))


@query
def ontology_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "articles"), triples_article(spark, sf_dir))


@query
def ontology_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "ner"), triples_ner(spark, sf_dir))


@query
def ontology_url_centric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "url_centric"), triples_url_centric(spark, sf_dir))


@query
def ontology_url_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "url_raw"), triples_url_raw(spark, sf_dir))


@query
def ontology_url_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "url_untyped"), triples_url_untyped(spark, sf_dir))


@query
def ontology_news_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.ontology_usage(rdf.ontology(spark, "news_content"), triples_news_content(spark, sf_dir))


@query
def bgp_count_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = [("?url_hash", rdf.RDF_TYPE, NS + "urlHash")]
    found = patterns.match_pattern(triples_url_centric(spark, sf_dir), urls, ["?url_hash"])
    return found.agg(F.count("url_hash").alias("url_count"))


DOMAIN_LABEL = [
    ("?domain_hash", rdf.RDF_TYPE, NS + "domainHash"),
    ("?url_hash", rdf.RDF_TYPE, NS + "urlHash"),
    ("?label", rdf.RDF_TYPE, NS + "newsLabel"),
    ("?url_hash", NS + "has_domain_hash", "?domain_hash"),
    ("?url_hash", NS + "has_news_label", "?label"),
]
DOMAIN_URL_BODY_LABEL = [
    *DOMAIN_LABEL,
    ("?body_hash", rdf.RDF_TYPE, NS + "bodyHash"),
    ("?url_hash", NS + "has_body_hash", "?body_hash"),
]


def _stored_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL-centred graph as a stored table, which each pattern scans on its own."""
    path = scratch_dir(spark, "triples")
    rdf.write_triples(triples_url_centric(spark, sf_dir), path)
    return rdf.read_triples(spark, path)


def _domain_label_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_url_graph(spark, sf_dir)
    found = patterns.match_pattern(stored, DOMAIN_LABEL, ["?domain_hash", "?label", "?url_hash"])
    return found.groupBy("domain_hash", "label").agg(F.count("url_hash").alias("url_count"))


@query
def bgp_domain_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain_label_urls(spark, sf_dir)


@query
def bgp_domain_url_body_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_url_graph(spark, sf_dir)
    names = ["?domain_hash", "?url_hash", "?body_hash", "?label"]
    found = patterns.match_pattern(stored, DOMAIN_URL_BODY_LABEL, names)
    return found.select(*[strip_namespace(F.col(c)).alias(c) for c in found.columns])


@query
def bgp_literal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one label in the form of the graph whose labels are literals, with their domain."""
    wanted = [
        ("?url", rdf.RDF_TYPE, NS + "url"),
        ("?url", NS + "has_news_label", patterns.Literal("reliable")),
        ("?url", NS + "has_domain", "?domain"),
    ]
    return patterns.match_pattern(triples_url_raw(spark, sf_dir), wanted, ["?url", "?domain"])


@query
def bindings_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions as saved JSON responses, read back to a table, prefixes stripped and counts as numbers."""
    solutions = _domain_label_urls(spark, sf_dir)
    binding = F.struct(*[F.struct(F.col(c).cast("string").alias("value")).alias(c) for c in solutions.columns])
    response = F.struct(F.struct(F.array(binding).alias("bindings")).alias("results"))
    saved = solutions.select(F.to_json(response).alias("response"))
    found = readers.bindings_to_table(saved, "response", ["domain_hash", "label", "url_count"])
    return found.select(
        strip_namespace(F.col("domain_hash")).alias("domain_hash"),
        strip_namespace(F.col("label")).alias("label"),
        F.col("url_count").cast("bigint").alias("url_count"),
    )


def _unique_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.all_loads(spark, sf_dir)
    return snapshot.latest_snapshot(rows, unique=True, tiebreak=("label", "file_name", "custom_columns"))


@query
def turtle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.article_documents(_unique_articles(spark, sf_dir))


@query
def documents_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written many to a file, indexed by their place, and fetched one by one by the names of all articles."""
    path = scratch_dir(spark, "named")
    articles = stored(_unique_articles(spark, sf_dir).select(*graph.DOCUMENT_COLUMNS), "unique-articles")
    sinks.write_documents(graph.article_documents(articles), f"{path}/text")
    named.write_document_index(spark, f"{path}/text", f"{path}/index")
    names = articles.select(F.sha2(webpage_id(F.col("article_id"), F.col("url_hash")), 256).alias("name"))
    return named.fetch_documents(spark.read.parquet(f"{path}/index"), names)


@query
def texts_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text fields of all articles dealt out by their bytes: how much there is, and how many of the partitions are
    heavier than twice the mean."""
    fields = entities.input_fields(tables.articles(spark, sf_dir))
    dealt = redistribute(fields, F.octet_length("text"), 16)
    n_bytes = F.sum(F.octet_length("text").cast("long")).alias("n_bytes")
    parts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n_texts"), n_bytes)
    mean = F.sum("n_bytes").over(Window.partitionBy()) / F.count("*").over(Window.partitionBy())
    parts = parts.withColumn("heavy", F.col("n_bytes") > 2 * mean)
    return parts.agg(F.sum("n_texts").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"), F.count_if("heavy").alias("n_heavy"))


@query
def ner_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_documents(entities.rule_entities(tables.articles(spark, sf_dir)))


@query
def ntriples_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "ntriples")
    sinks.write_text(rdf.ntriples(triples_news_content(spark, sf_dir)), path, "line")
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- entities -------------------------------------------------------------------------------------------------


@query
def ner_input_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.articles(spark, sf_dir)
    found = entities.input_fields(rows, all_text=True)
    return found.select("article_id", "url_hash", "source_column", "text")


@query
def ner_rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.rule_entities(tables.articles(spark, sf_dir))


@query
def ner_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in every text field of the article table that is not a hash."""
    articles = tables.full_articles(spark, sf_dir)
    return entities.rule_entities(articles, fields=entities.text_fields(articles, all_text=True))


@query
def ner_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of one to four words of the benchmark passages, and the whole passages, looked up in all articles."""
    passages = table(spark, sf_dir, "benchmark").select("text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(entities.WORD), F.lit(0))
    cut = passages.select(words.alias("words"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("n"))
    cut = cut.where(F.size("words") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))
    terms = cut.select(F.explode(phrases).alias("entity")).union(passages).distinct()
    return entities.gazetteer_entities(tables.articles(spark, sf_dir), terms.withColumn("entity_label", F.lit("MISC")))


@query
def ner_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.distinct_entities(entities.rule_entities(tables.articles(spark, sf_dir)))


def pattern_extractor(pattern: str, label: str) -> Callable[[], entities.Extractor]:
    """A stand-in for a loaded model; everything it needs travels with it to the executors."""

    def build() -> entities.Extractor:
        compiled = re.compile(pattern, re.ASCII)

        def extract(texts: Sequence[str]) -> list[list[tuple[str, str]]]:
            return [[(found, label) for found in compiled.findall(text)] for text in texts]

        return extract

    return build


@query
def ner_model_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    factory = pattern_extractor(entities.DEFAULT_RULES["EMAIL"], "EMAIL")
    return entities.model_entities(tables.articles(spark, sf_dir), factory).select(*ENTITY_COLUMNS)


# --- statistics and samples -----------------------------------------------------------------------------------


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide measurements per event: its value, the number in its properties, and the seconds since midnight."""
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "struct<k: double>")["k"]
    return events.select(
        "event_id",
        "event_type",
        F.col("value").alias("value_1a"),
        k.alias("value_1b"),
        F.round(elapsed_seconds(F.date_trunc("day", "ts"), F.col("ts")), 6).alias("value_1c"),
    )


@query
def bench_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "measurements")
    sinks.write_csv(_measurements(spark, sf_dir), path)
    schema = "event_id bigint, event_type string, value_1a double, value_1b double, value_1c double"
    return stats.melt(readers.read_csv(spark, path, schema), ["event_id", "event_type"])


@query
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.melt(_measurements(spark, sf_dir), ["event_id", "event_type"])
    summary = stats.summarize(long, ["event_type", "variable"])
    rounded = {c: F.round(c, 4) for c in ("mean", "std_dev", "median")}
    return summary.withColumns(rounded).orderBy("event_type", "variable")


@query
def bench_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stats.ols(_measurements(spark, sf_dir), ["event_type"], "value_1b", "value_1a")
    return lines.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


@query
def sample_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "sample")
    sinks.write_parquet(sampling.sample_rows(table(spark, sf_dir, "documents"), "doc_id", SAMPLE_SIZE), path)
    return spark.read.parquet(path)
