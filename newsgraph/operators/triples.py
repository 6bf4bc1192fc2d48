"""Articles, entities and cleaned records as RDF triples and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions import (
    XSD,
    decode_json_map,
    guess_type,
    prefixed_md5,
    sha256_hex,
    text_or_null,
    webpage_id,
    xsd_type,
)
from newsgraph.operators.rdf import (
    DEFAULT_NS,
    OWL,
    RDF_TYPE,
    RDFS_LABEL,
    Fact,
    Graph,
    Nested,
    Triple,
    blank_node,
    bnode_triple,
    date_facts,
    document_text,
    fact,
    graph_lines,
    graph_to_triples,
    iri_triple,
    link_fact,
    literal_triple,
    node,
    text,
    type_triple,
)

# Linked values of a publication: column, class, predicate, and whether the value is a hex digest.
LINKED_VALUES = [
    ("body_hash", "bodyHash", "has_body_hash", True),
    ("file_name_hash", "infoSource", "is_sourced_from", True),
    ("label", "classification", "has_classification", False),
    ("title_hash", "title", "has_title_hash", True),
    ("url_hash", "urlHash", "has_url_hash", True),
    ("author_hash", "author", "authored_by", True),
    ("country_of_origin", "country", "is_from_country", False),
    ("language", "language", "is_in_language", False),
]
ARTICLE_DATES = {"classification_date": "classifiedDate", "publication_date": "publishedDate"}
RECORD_DATES = {"scraped_at": "scraped_at", "inserted_at": "inserted_at", "updated_at": "updated_at"}

# The columns of the article table that graphs and documents are made of; texts are not among them.
DOCUMENT_COLUMNS = ("article_id", *[c for c, *_ in LINKED_VALUES], *ARTICLE_DATES, "custom_columns")


def _article_values(df: DataFrame, guess_datetime: bool = False) -> DataFrame:
    """The columns that article triples are made of, with the text 'null' as NULL, and the custom fields."""

    def typed(entry: Column) -> Column:
        value = text_or_null(entry["value"])
        datatype = F.when(value.isNotNull(), xsd_type(guess_type(value, guess_datetime)))
        return F.struct(
            entry["key"].alias("custom_key"), value.alias("custom_value"), datatype.alias("custom_type")
        )

    names = [c for c, *_ in LINKED_VALUES] + list(ARTICLE_DATES)
    return df.select(
        webpage_id(F.col("article_id"), F.col("url_hash")).alias("webpage"),
        *[text_or_null(F.col(c)).alias(c) for c in names],
        F.transform(F.map_entries(decode_json_map(F.col("custom_columns"))), typed).alias("custom"),
    )


def _custom_facts(ns: str, entry: str = "") -> tuple[Fact, ...]:
    """A class and a data property per key, and a typed literal per value; ``entry`` qualifies the field names."""
    pub = node(ns, "webpage", quote=False)
    term = node(ns, f"concat('cf_', {entry}custom_key)")
    blank = Triple(pub, term, blank_node("webpage", f"{entry}custom_key"), "bnode")
    valued = Triple(pub, term, f"{entry}custom_value", "literal", f"{entry}custom_type")
    return (
        fact(("custom_key",), type_triple(term, OWL + "Class"), type_triple(term, OWL + "DataProperty")),
        fact(("webpage", "custom_key"), iri_triple(pub, ns + "has_extra_class", term)),
        fact(("webpage",), iri_triple(pub, ns + "has_extra_class", text(ns + "extraClass"))),
        Fact(
            ("webpage", "custom_key", "custom_value", "custom_type"),
            (valued,),
            missing=(f"{entry}custom_value", (blank,)),
        ),
    )


def _custom_fields(ns: str) -> Nested:
    fields = ("custom_key", "custom_value", "custom_type")
    return Nested("custom", fields, lambda entry: _custom_facts(ns, entry))


def article_graph(
    ns: str = DEFAULT_NS, author_predicate: str = "authored_by", with_custom: bool = False
) -> Graph:
    pub = node(ns, "webpage", quote=False)
    facts = [
        fact(
            ("webpage",),
            type_triple(pub, ns + "publication"),
            literal_triple(pub, RDFS_LABEL, "webpage"),
            literal_triple(pub, ns + "turtleFile", "sha2(webpage, 256)", XSD + "string"),
        )
    ]
    for column, cls, predicate, is_digest in LINKED_VALUES:
        if column == "author_hash":
            predicate = author_predicate
        blank = blank_node("webpage", text(predicate))
        anonymous = (
            Triple(blank, text(RDF_TYPE), text(ns + cls), "iri", blank_subject=True),
            Triple(blank, text(RDFS_LABEL), blank, "bnode", blank_subject=True),
            bnode_triple(pub, ns + predicate, blank),
        )
        linked = iri_triple(pub, ns + predicate, node(ns, column, quote=not is_digest))
        facts.append(Fact(("webpage", column), (linked,), missing=(column, anonymous)))
    facts += date_facts(pub, ns, "webpage", ARTICLE_DATES)
    nodes = tuple((column, cls) for column, cls, *_ in LINKED_VALUES)
    nested = _custom_fields(ns) if with_custom else None
    return Graph(ns, nodes, tuple(facts), nested=nested, local="webpage")


def article_triples(
    df: DataFrame,
    ns: str = DEFAULT_NS,
    author_predicate: str = "authored_by",
    with_custom: bool = False,
    guess_datetime: bool = False,
) -> DataFrame:
    """Triples of article rows: the publication, its eight linked values and its literals.

    ``with_custom`` adds the triples of the custom fields in the same pass.
    """
    rows = _article_values(df, guess_datetime)
    return graph_to_triples(rows, article_graph(ns, author_predicate, with_custom))


def custom_triples(df: DataFrame, ns: str = DEFAULT_NS, guess_datetime: bool = False) -> DataFrame:
    """Triples of the custom fields only."""
    return graph_to_triples(
        _article_values(df, guess_datetime), Graph(ns, (), (), nested=_custom_fields(ns), local="webpage")
    )


def article_documents(
    df: DataFrame, ns: str = DEFAULT_NS, author_predicate: str = "authored_by", guess_datetime: bool = False
) -> DataFrame:
    """One document per article row: ``name`` (sha256 of the page id) and the sorted statements.

    All statements of a document come from one row, so this is a projection: no explode and no shuffle.
    """
    rows = _article_values(df, guess_datetime)
    lines = graph_lines(article_graph(ns, author_predicate, with_custom=True))
    return rows.select(sha256_hex(F.col("webpage")).alias("name"), document_text(lines).alias("document"))


def _entity_rows(df: DataFrame) -> DataFrame:
    page = webpage_id(F.col("article_id"), F.col("url_hash"))
    name = F.concat(
        F.lit("NER_"), sha256_hex(page), F.lit("_"), sha256_hex(F.col("entity")), F.lit("_"), F.col("entity_label")
    )
    return df.select(
        page.alias("webpage"), "entity", "entity_label", "source_column", name.alias("document_name")
    )


def entity_graph(ns: str = DEFAULT_NS, with_sources: bool = True) -> Graph:
    pub = node(ns, "webpage", quote=False)
    entity, label = node(ns, "entity"), node(ns, "entity_label")
    document = node(ns, "concat(document_name, '.ttl')")
    facts = [
        fact(("webpage",), type_triple(pub, ns + "publication")),
        fact(("webpage", "entity"), iri_triple(pub, ns + "has_ner_entity", entity)),
        fact(("entity", "entity_label"), iri_triple(entity, ns + "has_ner_label", label)),
        fact(
            ("webpage", "entity", "document_name"),
            type_triple(document, ns + "infoSource"),
            iri_triple(pub, ns + "is_sourced_from", document),
            iri_triple(entity, ns + "is_sourced_from", document),
        ),
    ]
    if with_sources:
        facts.append(fact(("entity", "source_column"), literal_triple(entity, ns + "ner_source", "source_column")))
    return Graph(ns, (("entity", "ner_entity"), ("entity_label", "ner_label")), tuple(facts))


def entity_triples(entities: DataFrame, ns: str = DEFAULT_NS) -> DataFrame:
    """Triples of extracted entities."""
    return graph_to_triples(_entity_rows(entities), entity_graph(ns))


def entity_documents(entities: DataFrame, ns: str = DEFAULT_NS) -> DataFrame:
    """One document per page, entity and label, naming every source column the entity was found in.

    The only group is the set of source columns, at most one per text field of the article table.
    """
    keys = ["webpage", "entity", "entity_label", "document_name"]
    grouped = _entity_rows(entities).groupBy(*keys).agg(F.collect_set("source_column").alias("sources"))
    fixed = graph_lines(entity_graph(ns, with_sources=False))
    source = literal_triple(node(ns, "entity"), ns + "ner_source", "c").line()
    lines = F.concat(fixed, F.expr(f"transform(sources, c -> {source})"))
    return grouped.select(F.col("document_name").alias("name"), document_text(lines).alias("document"))


def add_record_hashes(records: DataFrame) -> DataFrame:
    """Hash columns of the cleaned records: md5 of the URL, prefixed md5 of domain, title and body."""
    return records.withColumns(
        {
            "url_hash": F.md5("url"),
            "domain_hash": prefixed_md5("domain_", F.col("domain")),
            "title_hash": prefixed_md5("title_", F.col("title")),
            "body_hash": prefixed_md5("body_", F.col("body")),
        }
    )


def _hashed_url_graph(ns: str) -> Graph:
    url = node(ns, "url_hash", quote=False)
    links = [
        ("label", "newsLabel", "has_news_label", True),
        ("domain_hash", "domainHash", "has_domain_hash", False),
        ("title_hash", "titleHash", "has_title_hash", False),
        ("body_hash", "bodyHash", "has_body_hash", False),
    ]
    facts = [
        link_fact("url_hash", column, url, ns, predicate, node(ns, column, quote))
        for column, _, predicate, quote in links
    ]
    facts += date_facts(url, ns, "url_hash", RECORD_DATES)
    nodes = [("url_hash", "urlHash"), *[(column, cls) for column, cls, *_ in links]]
    return Graph(ns, tuple(nodes), tuple(facts), local="url_hash")


def _raw_url_graph(ns: str, typed: bool) -> Graph:
    """URLs and news ids as IRIs; the label is a literal object. ``typed=False`` is the older form without types."""
    url, title = node(ns, "url"), node(ns, "title_hash", quote=False)
    label_predicate = RDFS_LABEL if typed else ns + "label"
    facts = [
        fact(("url",), literal_triple(url, ns + "has_url", "url")),
        fact(("url", "news_id"), iri_triple(url, ns + "has_id", node(ns, "news_id"))),
        fact(("url", "label"), literal_triple(url, ns + "has_news_label", "label")),
        fact(("url", "domain"), iri_triple(url, ns + "has_domain", node(ns, "domain"))),
        fact(("title_hash", "title"), literal_triple(title, label_predicate, "title"), required=("title",)),
        link_fact("url", "title_hash", url, ns, "has_title", title),
        fact(("url", "body_hash"), literal_triple(url, ns + "has_body_hash", "body_hash")),
        *date_facts(url, ns, "url", RECORD_DATES),
    ]
    if typed:
        body = node(ns, "body_hash", quote=False)
        facts.append(fact(("url",), type_triple(url, ns + "url")))
        facts.append(fact(("title_hash",), type_triple(title, ns + "title"), required=("title_hash",)))
        facts.append(fact(("body_hash",), type_triple(body, ns + "bodyHash")))
    nodes = (("news_id", "newsId"), ("label", "newsLabel"), ("domain", "domain"))
    nodes = tuple((column, cls if typed else None) for column, cls in nodes)
    return Graph(ns, nodes, tuple(facts), label_predicate, local="url")


def _content_rows(records: DataFrame) -> DataFrame:
    """One row per text of a record: the news id, how it is linked, and the text with its digest."""
    texts = F.array(
        *[
            F.struct(F.lit(predicate).alias("predicate"), F.md5(column).alias("digest"), F.col(column).alias("text"))
            for column, predicate in (("title", "has_title"), ("body", "has_content"))
        ]
    )
    return records.select("news_id", F.inline(texts))


def _content_graph(ns: str) -> Graph:
    """News ids with their title and content; the whole texts are literals."""
    news, entity = node(ns, "news_id"), node(ns, "digest", quote=False)
    link = f"concat({text(ns)}, predicate)"
    blank = Triple(news, link, blank_node("news_id", "predicate"), "bnode")
    linked = Triple(news, link, entity, "iri")
    facts = (
        fact(("news_id",), literal_triple(news, ns + "label", "news_id")),
        fact(("digest", "text"), literal_triple(entity, ns + "label", "text"), required=("digest",)),
        Fact(("news_id", "predicate", "digest"), (linked,), missing=("digest", (blank,))),
    )
    return Graph(ns, (), facts)


URL_STYLES = ("hashed", "raw", "untyped", "content")


def url_triples(records: DataFrame, ns: str = DEFAULT_NS, style: str = "hashed") -> DataFrame:
    """Triples of cleaned records around their URL ('hashed', 'raw', 'untyped') or news id ('content')."""
    if style == "hashed":
        return graph_to_triples(add_record_hashes(records), _hashed_url_graph(ns))
    if style == "raw":
        return graph_to_triples(add_record_hashes(records), _raw_url_graph(ns, typed=True))
    if style == "untyped":
        plain = records.withColumns({"title_hash": F.md5("title"), "body_hash": F.md5("body")})
        return graph_to_triples(plain, _raw_url_graph(ns, typed=False))
    if style == "content":
        return graph_to_triples(_content_rows(records), _content_graph(ns))
    raise ValueError(f"style must be one of {URL_STYLES}")
