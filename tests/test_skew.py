"""One article, source or word that makes up a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import entities, profile, snapshot
from newsgraph.operators import triples as graph
from newsgraph.operators.clean import dedupe_last_wins
from newsgraph.operators.ingest import map_articles
from newsgraph.operators.sampling import sample_rows
from newsgraph.operators.triples import add_record_hashes
from newsgraph.sources.config import MappingConfig
from tests.helpers import column, rows

N = 3000
CONFIG = MappingConfig(
    {"body": "body", "url": "url", "label": "label", "title": "title", "file_name": "source"}, {}, ("row",)
)


@pytest.fixture(scope="module")
def source(spark):
    hot = F.col("id") % 3 == 0
    number = F.col("id").cast("string")
    return spark.range(N).select(
        F.col("id").alias("row"),
        F.when(hot, "the hot text of Anna Smith").otherwise(F.concat(F.lit("text "), number)).alias("body"),
        F.when(hot, "hot title").otherwise(F.concat(F.lit("title "), number)).alias("title"),
        F.when(hot, "hot url").otherwise(F.concat(F.lit("url "), number)).alias("url"),
        F.when(hot, "hot source").otherwise(F.concat(F.lit("source "), F.col("id") % 7)).alias("source"),
        F.concat(F.lit("label "), F.col("id") % 2).alias("label"),
    )


@pytest.fixture(scope="module")
def articles(source):
    return map_articles(source, CONFIG, "2024-01-01 00:00:00")[0]


def test_graph_of_copies_is_a_set(articles):
    found = graph.article_triples(articles, with_custom=True)
    n = found.count()
    assert n == found.distinct().count()
    pages = 1 + N * 2 // 3
    assert found.where(F.col("o").endswith("#publication")).count() == pages
    assert found.where(F.col("p").endswith("#has_classification")).count() == pages + 1  # the copies have both labels
    assert found.where(F.col("p").endswith("#cf_row")).count() == N  # every custom value is kept


def test_snapshot_keeps_all_tied_copies(articles):
    assert snapshot.latest_snapshot(articles).count() == N
    unique = snapshot.latest_snapshot(articles, unique=True, tiebreak=("label", "custom_columns"))
    assert unique.count() == 1 + N * 2 // 3
    assert graph.article_documents(unique).select("name").distinct().count() == unique.count()


def test_reports_count_every_copy(source):
    hashed = add_record_hashes(source.withColumnRenamed("source", "domain"))
    bag = profile.reused_bodies(hashed, distinct=False)
    assert [r["url_count"] for r in bag.limit(2).collect()] == [N // 6, N // 6]
    assert profile.reused_bodies(hashed).first()["url_count"] == 1
    assert profile.cross_domain_bodies(hashed).first()["label_count"] == 2
    expected = Counter((f"source {i % 7}" if i % 3 else "hot source", f"label {i % 2}") for i in range(N))
    counts = profile.count_by(source, "source", "label")
    assert {(r["source"], r["label"]): r["n"] for r in counts.collect()} == dict(expected)


def test_entities_of_copies(spark, articles):
    found = entities.rule_entities(articles)
    assert found.count() == N // 3
    assert entities.distinct_entities(found).count() == 1
    terms = spark.createDataFrame([("hot text", "MISC"), ("text", "MISC")], "entity string, entity_label string")
    counts = Counter(column(entities.gazetteer_entities(articles, terms), "entity"))
    assert counts == {"hot text": N // 3, "text": N}
    documents = graph.entity_documents(found)
    assert documents.count() == 1


def test_last_wins_and_sample(source):
    last = dedupe_last_wins(source, "title", ("row",))
    assert last.where("title = 'hot title'").first()["row"] == N - 3
    assert last.count() == 1 + N * 2 // 3
    assert sample_rows(source, "title", 1500).count() == 1500


def test_reconcile_with_a_hot_key(source):
    right = source.where("label = 'label 0'")
    found = {r[0]: r[1:] for r in rows(profile.reconcile(source, right, "url"))}
    assert found["hot url"] == (N // 3, N // 6, "different")
    assert len(found) == 1 + N * 2 // 3
