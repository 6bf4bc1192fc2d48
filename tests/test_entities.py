import random
import re

import pytest

from newsgraph.operators import entities, rdf
from newsgraph.operators.ingest import map_articles
from newsgraph.operators.snapshot import append_articles
from newsgraph.operators.triples import entity_documents, entity_triples
from newsgraph.plans import jobs
from newsgraph.plans.tables import CONFIG
from newsgraph.schema import ENTITY_COLUMNS
from tests.helpers import column, rows

SCHEMA = "article_id string, url_hash string, publication_date string, title string, body string, label string"
DATA = [
    ("a", "h1", "2021", "Anna Smith wins", "Mail anna@x.org to Anna Smith or Anna Smith. new york city", "fake"),
    ("b", "h2", "2021", "null", "New York City, new\nYORK", "null"),
    ("c", "h3", None, None, "nothing", "x"),
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_field_choice(articles):
    assert entities.text_fields(articles) == ["title", "body"]
    everything = ["article_id", "publication_date", "title", "body", "label"]
    assert entities.text_fields(articles, all_text=True) == everything
    found = entities.input_fields(articles)
    assert rows(found.select("article_id", "source_column")) == [
        ("a", "body"), ("a", "title"), ("b", "body"), ("c", "body"),
    ]


def test_rules_find_each_entity_once_per_field(articles):
    found = entities.rule_entities(articles)
    assert found.columns == ENTITY_COLUMNS
    assert rows(found.select("article_id", "source_column", "entity", "entity_label")) == [
        ("a", "body", "Anna Smith", "MISC"),
        ("a", "body", "anna@x.org", "EMAIL"),
        ("a", "title", "Anna Smith", "MISC"),
        ("b", "body", "New York City", "MISC"),
    ]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_gazetteer_agrees_with_brute_force(spark, articles):
    terms = [("New York", "LOC"), ("new york city", "LOC"), ("Anna", "PER"), ("absent", "ORG")]
    gazetteer = spark.createDataFrame(terms, "entity string, entity_label string")
    expected = []
    for article, _, _, title, body, _ in DATA:
        for name, text in (("title", title), ("body", body)):
            if text and text != "null":
                words = " " + " ".join(re.findall(r"\w+", text.lower())) + " "
                expected += [(article, name, t, label) for t, label in terms if f" {t.lower()} " in words]
    found = entities.gazetteer_entities(articles, gazetteer)
    assert rows(found.select("article_id", "source_column", "entity", "entity_label")) == sorted(expected)
    for broadcast_limit in ("-1", "10485760"):  # the same rows with a shuffle join and with a broadcast join
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)
        assert entities.gazetteer_entities(articles, gazetteer).count() == len(expected)


def test_model_is_built_once_per_partition(spark, articles, tmp_path):
    log = str(tmp_path / "log")

    def factory():
        with open(log, "a") as handle:
            handle.write("built\n")

        def extract(texts):
            return [[("x", "PER"), ("x", "PER"), (t[:1], "ORG")] if len(t) > 8 else [] for t in texts]

        return extract

    found = entities.model_entities(articles, factory, partitions=2)
    assert rows(found.select("article_id", "source_column", "entity", "entity_label")) == [
        ("a", "body", "M", "ORG"), ("a", "body", "x", "PER"), ("a", "title", "A", "ORG"), ("a", "title", "x", "PER"),
        ("b", "body", "N", "ORG"), ("b", "body", "x", "PER"),
    ]
    with open(log) as handle:
        assert len(handle.readlines()) <= 2


def test_entity_graph(articles):
    found = entities.rule_entities(articles)
    graph = entity_triples(found)
    assert graph.count() == graph.distinct().count()
    counts = {}
    for p in column(graph, "p"):
        counts[p.split("#")[1]] = counts.get(p.split("#")[1], 0) + 1
    # 2 pages, 3 entities, 2 labels, 3 documents; Anna Smith comes from two columns
    assert counts == {
        "type": 2 + 3 + 2 + 3, "label": 3 + 2, "has_ner_entity": 3, "has_ner_label": 3, "is_sourced_from": 6,
        "ner_source": 4,
    }


def test_entity_documents(articles):
    found = entities.rule_entities(articles).where("article_id = 'a' AND entity_label = 'MISC'")
    documents = entity_documents(found).collect()
    assert len(documents) == 1
    assert re.fullmatch(r"NER_[0-9a-f]{64}_[0-9a-f]{64}_MISC", documents[0]["name"])
    lines = column(rdf.ntriples(entity_triples(found)), "line")
    assert documents[0]["document"].split("\n") == sorted(lines)


def test_distinct_entities(articles):
    found = entities.rule_entities(articles)
    assert entities.distinct_entities(found.union(found)).count() == found.count()


def test_entity_job(spark, tmp_path):
    columns = "text string, title string, site_url string, type string, file_name string"
    source = spark.createDataFrame([("Anna Smith met Bob Jones", "title", "u", "fake", "f")], columns)
    append_articles(map_articles(source, CONFIG, "2024-01-01 00:00:00")[0], str(tmp_path / "articles"), "1")
    jobs.export_entities(spark, str(tmp_path / "articles"), str(tmp_path / "graph"), str(tmp_path / "documents"))
    stored = rdf.read_triples(spark, str(tmp_path / "graph"))
    assert stored.where("p LIKE '%#has_ner_entity'").count() == 2
    names = [v for v in column(spark.read.text(str(tmp_path / "documents")), "value") if v.startswith("# NER_")]
    assert len(names) == 2


def test_gazetteer_terms_of_any_length_are_cut_like_texts(spark, articles):
    body = "The U.S. Senate met O'Neil: one two three four five six seven. One two three four six"
    text = articles.limit(1).selectExpr("article_id", "url_hash", "publication_date", f'"{body}" AS body')
    terms = ["U.S. Senate", "O'Neil", "one two three four five six", "one two three four seven", "two", "--", "SIX one"]
    gazetteer = spark.createDataFrame([(t, "MISC") for t in [*terms, "two"]], "entity string, entity_label string")
    found = entities.gazetteer_entities(text, gazetteer)
    assert sorted(r["entity"] for r in found.collect()) == sorted([*terms[:3], "two"])
    assert entities.gazetteer_entities(text, gazetteer.limit(0)).count() == 0
    assert entities.gazetteer_entities(text.limit(0), gazetteer).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_gazetteer_on_few_words_agrees_with_brute_force(spark, seed):
    draw = random.Random(seed)
    few = ["a", "b", "c", "Dé", "e1"]  # every word is frequent, most terms nearly match
    texts = [" ".join(draw.choices(few, k=draw.choice([1, 2, 5, 40]))) for _ in range(40)] + ["", "-", "a " * 3000]
    schema = "article_id string, url_hash string, publication_date string, body string"
    articles = spark.createDataFrame([(str(i), "h", None, t) for i, t in enumerate(texts)], schema)
    terms = {" ".join(draw.choices(few, k=draw.choice([1, 2, 3, 4, 5, 8, 9, 12]))) for _ in range(60)}
    terms |= {" ".join(texts[3].split()[:30]), texts[5] or "x", "A, b", "absent a"}
    gazetteer = spark.createDataFrame([(t, label) for t in sorted(terms) for label in ("P", "Q")], "entity string, entity_label string")

    def cut(text):
        return " " + " ".join(re.findall(r"\w+", text.lower())) + " "

    expected = [(str(i), t, x) for i, text in enumerate(texts) for t in terms for x in "PQ" if cut(t).strip() and cut(t) in cut(text)]
    found = entities.gazetteer_entities(articles, gazetteer)
    assert rows(found.select("article_id", "entity", "entity_label")) == sorted(expected, key=str)


def test_terms_are_anchored_at_their_rarest_word(spark):
    words = spark.createDataFrame([(i, w) for i, t in enumerate(["the of x", "the of", "the"]) for w in t.split()], "row int, word string")
    terms = [("of the", ["of", "the"]), ("the x of", ["the", "x", "of"]), ("the zebra", ["the", "zebra"])]
    terms = spark.createDataFrame([(e, "T", w) for e, w in terms], "entity string, entity_label string, term_words array<string>")
    got = entities.anchored_terms(words, terms).select("entity", "anchor", "at", "frequency")
    assert rows(got) == [("of the", "of", 0, 2), ("the x of", "x", 1, 1)]
