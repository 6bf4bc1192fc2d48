import re

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import rdf, sinks
from newsgraph.operators import triples as graph
from newsgraph.operators.ingest import map_articles
from newsgraph.operators.snapshot import append_articles, read_articles
from newsgraph.plans import jobs
from newsgraph.schema import RECORD_COLUMNS, TRIPLE_COLUMNS
from newsgraph.session import stored
from newsgraph.sources.config import MappingConfig
from newsgraph.sources.readers import read_sidecars
from tests.helpers import column, rows

NS = rdf.DEFAULT_NS
NTRIPLES = re.compile(
    r'^(<[^<>"{}|^`\\\s]*>|_:[A-Za-z0-9]+) <[^<>\s]+> '
    r'(<[^<>"{}|^`\\\s]*>|_:[A-Za-z0-9]+|"([^"\\\n\r]|\\["\\nr])*"(\^\^<[^<>\s]+>)?) \.$'
)
CONFIG = MappingConfig(
    {"body": "body", "url": "url", "label": "label", "title": "title", "file_name": "file"},
    {"author": "author", "language": "language", "publication_date": "published"},
    ("likes", "score", "note"),
)
SCHEMA = (
    "body string, url string, label string, title string, file string, author string, language string, "
    "published string, likes long, score double, note string"
)
ARTICLES = [
    ('text "quoted"\nline \\ two', "u1", "fake news", "t1", "f", "Ann", "en", "2021-01-01T00:00:00", 5, 1.5, "x"),
    ("same", "u2", None, "same", "f", None, "en", None, None, None, ""),
    ("same", "u2", "fake news", "same", "f", None, "en", None, 7, 2.0, "12"),
]


@pytest.fixture(scope="module")
def articles(spark):
    accepted, _ = map_articles(spark.createDataFrame(ARTICLES, SCHEMA), CONFIG, "2024-01-01 00:00:00")
    return accepted.cache()


def test_triples_are_a_set(articles):
    found = graph.article_triples(articles)
    assert found.columns == TRIPLE_COLUMNS
    assert found.count() == found.distinct().count()


def test_one_article_gives_29_triples(articles):
    one = articles.where("url = 'u1'")
    found = graph.article_triples(one)
    # 3 for the page, 3 for each of the 8 linked values, 2 dates
    assert found.count() == 29
    assert found.where("o_kind = 'bnode'").count() == 3 + 1 - 1  # country: label and link; classification date
    dates = found.where(F.col("p") == NS + "publishedDate").first()
    assert (dates["o"], dates["o_datatype"]) == ("2021-01-01T00:00:00", "http://www.w3.org/2001/XMLSchema#dateTime")
    label = found.where(F.col("p") == NS + "has_classification").first()
    assert (label["o"], label["o_kind"]) == (NS + "fake%20news", "iri")
    assert found.where(F.col("p") == NS + "authored_by").count() == 1
    assert graph.article_triples(one, author_predicate="is_published_by").where(F.col("p").endswith("_by")).count() == 1


def test_blank_nodes_are_the_same_in_every_run(articles):
    first, second = (graph.article_triples(articles).where("o_kind = 'bnode'") for _ in range(2))
    assert rows(first) == rows(second)


def test_merging_again_changes_nothing(spark, articles, tmp_path):
    found = graph.article_triples(articles)
    assert rdf.merge_triples(found, found).count() == found.count()
    rdf.write_triples(found, str(tmp_path / "written"))
    written = rdf.read_triples(spark, str(tmp_path / "written"))
    assert rows(written) == rows(found)
    one = executed_plan(written.where(F.col("p") == NS + "has_title_hash"))
    assert "PartitionFilters: [isnotnull(p" in one


def test_imports_into_a_store(spark, articles, tmp_path):
    found = graph.article_triples(articles, with_custom=True)
    store = rdf.TripleStore(spark, str(tmp_path / "store's"), buckets=4)
    for part in (found.where("s < o"), found, found.union(found), found.limit(0)):
        store.append(part)
        store = rdf.TripleStore(spark, store.path, buckets=4)  # opened again
    assert rows(store.read()) == rows(found) == rows(rdf.read_triples(spark, store.path))
    wanted = [NS + "has_title_hash", NS + "absent"]
    assert rows(store.read(wanted)) == rows(found.where(F.col("p").isin(wanted)))
    assert "PartitionFilters: [p_group" in executed_plan(store.read(wanted))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("triples_")]


def test_a_store_is_not_shuffled_and_its_folders_are_bounded(spark, tmp_path):
    many = spark.range(500).selectExpr(
        "concat('s', id) AS s", "concat('http://x#cf_key', id) AS p", "string(id) AS o", "'literal' AS o_kind", "null AS o_datatype"
    )
    store = rdf.TripleStore(spark, str(tmp_path / "store"), buckets=4)
    store.append(many)
    assert [f.name for f in (tmp_path / "store").iterdir() if f.is_dir()] == ["p_group=0"]
    assert len(list((tmp_path / "store" / "p_group=0").glob("*.parquet"))) <= 4
    store.append(many.withColumn("p", F.concat(F.lit("http://x#p"), "o")))
    folders = [f for f in (tmp_path / "store").iterdir() if f.is_dir()]
    assert len(folders) <= rdf.PREDICATE_GROUPS
    with rdf._store_table(spark, store.path, 4) as name:
        plan = executed_plan(store.new_triples(many, name))
    join = plan[plan.index("SortMergeJoin") :]
    scan = join[: join.index("spark_catalog.default")]
    assert "Bucketed: true" in plan and scan.count("Exchange") == 1  # the new graph is dealt to the buckets once
    assert store.read().count() == 1000


def test_an_import_deals_new_triples_once_and_writes_them_where_they_are_found(spark, tmp_path, monkeypatch):
    many = spark.range(500).selectExpr(
        "concat('s', id) AS s", "concat('http://x#p', id % 5) AS p", "string(id) AS o", "'literal' AS o_kind", "null AS o_datatype"
    )
    store = rdf.TripleStore(spark, str(tmp_path / "store"), buckets=4)
    store.append(many.where("o < '3'"))
    before = set((tmp_path / "store").rglob("*.parquet"))
    kept, plans, write = [], [], rdf.TripleStore._write

    def seen(self, fresh, name):
        plans.append(executed_plan(fresh))
        write(self, fresh, name)

    monkeypatch.setattr(rdf, "stored", lambda df, name: kept.append(name) or stored(df, name))
    monkeypatch.setattr(rdf.TripleStore, "_write", seen)
    store.append(many.union(many))
    assert kept == [] and len(plans) == 1  # no copy of the new triples beside the store
    assert plans[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plans[0]
    fresh = set((tmp_path / "store").rglob("*.parquet")) - before
    places = [(f.parent.name, f.name.split("_")[-1].split(".")[0]) for f in fresh]  # group and bucket
    assert len(places) == len(set(places)) and len({bucket for _, bucket in places}) == 4
    assert rows(store.read()) == rows(many)


def test_a_graph_reads_its_input_once(spark, articles):
    """The joins and texts behind the articles are not computed again for the shared facts or for pages with different rows."""
    given = articles.withColumn("label", F.lit("x")).union(articles).union(articles)
    found = graph.article_triples(given, with_custom=True)
    plan = executed_plan(found)
    assert not re.search("ExistingRDD|LocalTableScan", plan) and "FileScan parquet" in plan
    both = graph.article_triples(given.where("label = 'x'"), with_custom=True)
    assert rows(found) == rows(both.union(graph.article_triples(articles, with_custom=True)).distinct())


def test_custom_literals_are_typed(articles):
    found = graph.custom_triples(articles.where("url = 'u1'"))
    values = {r["p"].split("#")[1]: (r["o"], (r["o_datatype"] or "").split("#")[-1]) for r in
              found.where(F.col("p").startswith(NS + "cf_")).collect()}
    assert values == {"cf_likes": ("5", "integer"), "cf_score": ("1.5", "float"), "cf_note": ("x", "string")}
    assert found.count() == 3 * 2 + 3 + 1 + 3
    missing = graph.custom_triples(articles.where("url = 'u2' AND label = 'null'"))
    kinds = rows(missing.where(F.col("p").startswith(NS + "cf_")).select("p", "o_kind", "o_datatype"))
    assert kinds == [
        (NS + "cf_likes", "bnode", None),
        (NS + "cf_note", "literal", None),
        (NS + "cf_score", "bnode", None),
    ]


def test_one_pass_gives_both_graphs(articles):
    both = graph.article_triples(articles).unionByName(graph.custom_triples(articles))
    assert rows(graph.article_triples(articles, with_custom=True)) == rows(both)


def test_ntriples_lines_are_valid(spark, articles):
    everything = (
        graph.article_triples(articles)
        .unionByName(graph.custom_triples(articles))
        .unionByName(rdf.ontology(spark, "articles"))
        .unionByName(rdf.ontology(spark, "ner"))
    )
    lines = column(rdf.ntriples(everything), "line")
    assert lines and all(NTRIPLES.match(line) for line in lines)


def test_documents_hold_exactly_the_triples_of_their_article(articles):
    one = articles.where("url = 'u1'")
    documents = graph.article_documents(one).collect()
    lines = column(rdf.ntriples(graph.article_triples(one).unionByName(graph.custom_triples(one))), "line")
    assert len(documents) == 1
    assert documents[0]["document"].split("\n") == sorted(lines)
    named = [line for line in lines if "turtleFile" in line]
    assert documents[0]["name"] in named[0]


def test_documents_need_no_shuffle(articles):
    assert "Exchange" not in executed_plan(graph.article_documents(articles))


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_of_a_stored_table_reads_no_texts_and_shuffles_no_page_triples(spark, articles, tmp_path):
    one_per_page = articles.dropDuplicates(["article_id", "url_hash"])
    append_articles(one_per_page.union(one_per_page), str(tmp_path / "articles"), "1")  # copies only
    found = graph.article_triples(read_articles(spark, str(tmp_path / "articles")), with_custom=True)
    plan = executed_plan(found)
    assert plan.count("Exchange hashpartitioning") == 1  # the shared nodes and facts
    assert "Exchange" not in plan[: plan.index("FileScan parquet")]  # the pages come first in the union
    scanned = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert len(scanned) == 2 and "body_hash#" in scanned[1]
    assert not any("body#" in s or "title#" in s for s in scanned)
    assert rows(found) == rows(graph.article_triples(one_per_page, with_custom=True))


def test_pages_with_different_rows_keep_all_their_facts(spark, articles):
    first = articles.limit(1)
    changed = [first.withColumn("label", F.lit(label)) for label in ("x", "y", "x", "null")]
    changed.append(first.withColumn("custom_columns", F.lit('{"k":"v"}')))
    every = articles
    for df in changed:
        every = every.unionByName(df)
    found = graph.article_triples(every, with_custom=True)
    parts = [graph.article_triples(df, with_custom=True) for df in [articles, *changed]]
    expected = parts[0]
    for df in parts[1:]:
        expected = expected.union(df)
    assert rows(found) == rows(expected.distinct())


def test_documents_sink(spark, articles, tmp_path):
    documents = graph.article_documents(articles.where("url = 'u1'"))
    sinks.write_documents(documents, str(tmp_path / "docs"))
    saved = column(spark.read.text(str(tmp_path / "docs")), "value")
    first = documents.first()
    assert saved[0] == f"# {first['name']}"
    assert saved[1:] == first["document"].split("\n")


RECORDS = [
    ("0", "10", "d.com", "fake", "http://d.com/a b", "body one", "2018-01-01", "2018-01-02", "2018-01-03", "title one"),
    ("1", "11", "d.com", "fake", "http://d.com/2", "body one", None, "2018-01-02", "2018-01-03", None),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, ", ".join(f"{c} string" for c in RECORD_COLUMNS))


def predicates(df):
    return dict(rows(df.groupBy("p").count().select(F.element_at(F.split("p", "#"), -1), "count")))


def test_hashed_url_graph(records):
    found = graph.url_triples(records, style="hashed")
    # nodes: 2 urls, 1 label, 1 domain, 1 title, 1 body
    assert predicates(found) == {
        "type": 6, "label": 6, "has_news_label": 2, "has_domain_hash": 2, "has_title_hash": 2, "has_body_hash": 2,
        "scraped_at": 2, "inserted_at": 2, "updated_at": 2,
    }
    assert found.where("o_kind = 'bnode'").count() == 2  # missing title, missing stamp
    assert all(NTRIPLES.match(line) for line in column(rdf.ntriples(found), "line"))


def test_raw_and_untyped_url_graph(records):
    raw = graph.url_triples(records, style="raw")
    assert predicates(raw) == {
        "type": 2 + 2 + 1 + 1 + 1 + 1, "has_url": 2, "has_id": 2, "has_news_label": 2, "has_domain": 2, "has_title": 2,
        "has_body_hash": 2, "label": 2 + 1 + 1 + 1, "scraped_at": 2, "inserted_at": 2, "updated_at": 2,
    }
    assert raw.where((F.col("s") == NS + "http%3A//d.com/a%20b") & (F.col("p") == NS + "has_url")).count() == 1
    untyped = graph.url_triples(records, style="untyped")
    assert "type" not in predicates(untyped)
    assert untyped.where(F.col("p") == NS + "label").count() == 5
    assert untyped.where(F.col("p") == rdf.RDFS_LABEL).count() == 0


def test_content_graph(records):
    found = graph.url_triples(records, style="content")
    assert predicates(found) == {"label": 2 + 1 + 1, "has_title": 2, "has_content": 2}
    assert found.where("o = 'body one' AND o_kind = 'literal'").count() == 1
    with pytest.raises(ValueError):
        graph.url_triples(records, style="other")


def test_sidecars(spark, records, tmp_path):
    jobs.export_records(records, str(tmp_path / "t"), str(tmp_path / "s"))
    flat = {r["url"]: r for r in read_sidecars(spark, str(tmp_path / "s")).collect()}
    assert len(flat) == 2
    assert flat["http://d.com/2"]["title_hash"] is None  # no title, no hash
    assert flat["http://d.com/a b"]["body_hash"].startswith("body_")
    assert flat["http://d.com/a b"]["domain_hash"].startswith("domain_")


def test_ontology_counts(spark):
    sizes = {kind: rdf.ontology(spark, kind).count() for kind in rdf.ONTOLOGIES}
    assert sizes == {
        "articles": 27, "ner": 9, "url_centric": 16, "url_raw": 17, "url_untyped": 17, "news_content": 7,
    }
    custom = rdf.ontology(spark, "ner", "http://other/#")
    assert all(s.startswith("http://other/#") for s in column(custom, "s"))


def test_every_used_term_is_declared(spark, articles):
    found = graph.article_triples(articles)
    declared = set(column(rdf.ontology(spark, "articles"), "s"))
    used = set(column(found.where(F.col("p").startswith(NS)).select("p").distinct(), "p"))
    used |= set(column(found.where(F.col("p") == rdf.RDF_TYPE).select("o").distinct(), "o"))
    assert used <= declared
    usage = {r["s"]: r["n_uses"] for r in rdf.ontology_usage(rdf.ontology(spark, "articles"), found).collect()}
    assert usage[NS + "publication"] == 2 and usage[NS + "classified_on"] == 0


def test_graph_jobs(spark, articles, tmp_path):
    table = str(tmp_path / "articles")
    append_articles(articles, table, "1")
    jobs.export_graph(spark, table, str(tmp_path / "graph"))
    stored = rdf.read_triples(spark, str(tmp_path / "graph"))
    assert stored.where(F.col("o") == NS + "publication").count() == 2
    jobs.export_documents(spark, table, str(tmp_path / "docs"))
    names = [v for v in column(spark.read.text(str(tmp_path / "docs")), "value") if v.startswith("# ")]
    assert len(names) == len(set(names)) == 2
