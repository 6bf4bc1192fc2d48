"""Vocabulary, ontologies and the triple model shared by all graph builders.

A graph is a set of rows ``s, p, o, o_kind, o_datatype``; ``o_kind`` is 'iri', 'literal' or 'bnode'. Builders
describe a row of input as *facts*: small groups of columns that fully determine some triples. Facts are
de-duplicated before they are expanded, so the shuffle carries the short fact keys and never the finished triples.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.functions import XSD, iri_quote_sql
from newsgraph.schema import TRIPLE_COLUMNS, TRIPLE_SCHEMA
from newsgraph.session import make_folder, stored

DEFAULT_NS = "https://newsgraph.example/ns#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
OWL = "http://www.w3.org/2002/07/owl#"

# The declared terms of each graph form.
ONTOLOGIES = {
    "articles": {
        "Class": [
            "bodyHash",
            "urlHash",
            "author",
            "title",
            "country",
            "language",
            "classification",
            "publication",
            "infoSource",
            "extraClass",
        ],
        "ObjectProperty": [
            "has_body_hash",
            "classified_by",
            "has_url_hash",
            "authored_by",
            "has_title_hash",
            "is_from_country",
            "is_in_language",
            "has_classification",
            "is_published_by",
            "is_sourced_from",
            "published_on",
            "classified_on",
            "has_extra_class",
            "is_extra_class",
        ],
        "DataProperty": ["publishedDate", "classifiedDate", "turtleFile"],
    },
    "ner": {
        "Class": ["publication", "ner_entity", "ner_label", "ner_source"],
        "ObjectProperty": ["has_ner_entity", "has_ner_label", "has_url_hash", "is_in_language"],
        "DataProperty": ["ner_source"],
    },
    "url_centric": {
        "Class": ["titleHash", "domainHash", "urlHash", "newsLabel", "bodyHash"],
        "ObjectProperty": [
            "has_url_hash",
            "has_title_hash",
            "has_body_hash",
            "has_news_label",
            "scraped_at",
            "inserted_at",
            "updated_at",
            "has_domain_hash",
        ],
        "DataProperty": ["scrapedDate", "insertedDate", "updatedDate"],
    },
    "url_raw": {
        "Class": ["newsId", "title", "domain", "url", "newsLabel", "bodyHash"],
        "ObjectProperty": [
            "has_id",
            "has_url",
            "has_title",
            "has_body_hash",
            "has_news_label",
            "scraped_at",
            "inserted_at",
            "updated_at",
        ],
        "DataProperty": ["scrapedDate", "insertedDate", "updatedDate"],
    },
    "url_untyped": {
        "Class": [
            "newsId",
            "title",
            "domain",
            "url",
            "newsLabel",
            "bodyHash",
            "scrapedDate",
            "insertedDate",
            "updatedDate",
        ],
        "ObjectProperty": [
            "has_id",
            "has_url",
            "has_title",
            "has_body_hash",
            "has_news_label",
            "scraped_at",
            "inserted_at",
            "updated_at",
        ],
        "DataProperty": [],
    },
    "news_content": {
        "Class": ["newsId", "title", "content", "contentHash"],
        "ObjectProperty": ["has_title", "has_content", "has_content_hash"],
        "DataProperty": [],
    },
}


def ontology(spark: SparkSession, kind: str, ns: str = DEFAULT_NS) -> DataFrame:
    """Declarations of one graph form, emitted once instead of once per article."""
    rows = [
        (ns + term, RDF_TYPE, OWL + group, "iri", None) for group, terms in ONTOLOGIES[kind].items() for term in terms
    ]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA)


def ontology_usage(declared: DataFrame, triples: DataFrame) -> DataFrame:
    """Every declaration with the number of triples that use it as predicate, or as class in a type triple."""
    used = triples.select(F.when(F.col("p") == RDF_TYPE, F.col("o")).otherwise(F.col("p")).alias("term"))
    uses = used.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    joined = declared.join(uses, declared["s"] == uses["term"], "left")
    return joined.select("s", "p", "o", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_uses"))


# Expressions of the graph builders are SQL text: a graph has hundreds of small ones, and one parse of the text is
# much cheaper than a call into the JVM for each of them.


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def node(ns: str, value: str, quote: bool = True) -> str:
    """IRI of a value under the namespace; hex digests need no quoting."""
    return f"concat({text(ns)}, {iri_quote_sql(value) if quote else value})"


def blank_node(key: str, predicate: str) -> str:
    """A blank node label that is the same in every run."""
    return f"concat('_:b', sha2(concat_ws('|', {key}, {predicate}), 256))"


@dataclass(frozen=True)
class Triple:
    """One triple; all parts are SQL text. ``kind`` is 'iri', 'literal' or 'bnode'."""

    s: str
    p: str
    o: str
    kind: str
    datatype: str | None = None
    blank_subject: bool = False

    def struct(self) -> str:
        values = (self.s, self.p, self.o, text(self.kind), f"CAST({self.datatype or 'NULL'} AS STRING)")
        fields = [f"'{name}', {value}" for name, value in zip(TRIPLE_COLUMNS, values)]
        return f"named_struct({', '.join(fields)})"

    def line(self) -> str:
        """The triple as an N-Triples statement (N-Triples is a subset of Turtle)."""
        subject = self.s if self.blank_subject else f"'<', {self.s}, '>'"
        target = {
            "iri": f"'<', {self.o}, '>'",
            "bnode": self.o,
            "literal": _literal(self.o, self.datatype),
        }[self.kind]
        return f"concat({subject}, ' <', {self.p}, '> ', {target}, ' .')"


def _literal(value: str, datatype: str | None) -> str:
    """A quoted literal with its datatype, if any."""
    escaped = f"replace({value}, chr(92), repeat(chr(92), 2))"
    for found, wanted in (("chr(34)", "chr(34)"), ("chr(10)", "'n'"), ("chr(13)", "'r'")):
        escaped = f"replace({escaped}, {found}, concat(chr(92), {wanted}))"
    typed = f"coalesce(concat('^^<', {datatype}, '>'), '')" if datatype else "''"
    return f"""concat('"', {escaped}, '"', {typed})"""


def iri_triple(s: str, predicate: str, o: str) -> Triple:
    return Triple(s, text(predicate), o, "iri")


def literal_triple(s: str, predicate: str, o: str, datatype: str | None = None) -> Triple:
    return Triple(s, text(predicate), o, "literal", text(datatype) if datatype else None)


def bnode_triple(s: str, predicate: str, o: str) -> Triple:
    return Triple(s, text(predicate), o, "bnode")


def type_triple(s: str, cls: str) -> Triple:
    return iri_triple(s, RDF_TYPE, text(cls))


@dataclass(frozen=True)
class Fact:
    """Triples that depend only on the text columns ``keys``."""

    keys: tuple[str, ...]
    triples: tuple[Triple, ...]
    required: tuple[str, ...] = ()  # the fact is skipped where one of these is NULL
    missing: tuple[str, tuple[Triple, ...]] | None = None  # other triples where this column is NULL

    def array(self, render: Callable[[Triple], str]) -> str:
        usual = f"array({', '.join(map(render, self.triples))})"
        if not self.missing:
            return usual
        column, others = self.missing
        return f"IF({column} IS NULL, array({', '.join(map(render, others))}), {usual})"


def fact(keys: tuple[str, ...], *triples: Triple, required: tuple[str, ...] = ()) -> Fact:
    return Fact(keys, triples, required)


def link_fact(key: str, column: str, s: str, ns: str, predicate: str, target: str) -> Fact:
    """A link to the node of a value, or to a blank node when the value is missing."""
    blank = bnode_triple(s, ns + predicate, blank_node(key, text(predicate)))
    return Fact((key, column), (iri_triple(s, ns + predicate, target),), missing=(column, (blank,)))


def date_facts(s: str, ns: str, key: str, columns: dict[str, str]) -> list[Fact]:
    """xsd:dateTime literals by input column; missing values become blank nodes."""
    return [
        Fact(
            (key, column),
            (literal_triple(s, ns + predicate, column, XSD + "dateTime"),),
            missing=(column, (bnode_triple(s, ns + predicate, blank_node(key, text(predicate))),)),
        )
        for column, predicate in columns.items()
    ]


@dataclass(frozen=True)
class Nested:
    """Facts about every element of an array column of structs."""

    column: str
    fields: tuple[str, ...]
    facts: Callable[[str], tuple[Fact, ...]]  # called with the prefix of the field names, '' or 'e.'


@dataclass(frozen=True)
class Graph:
    """What one row of input says: values that become labelled nodes of a class, and facts about them."""

    ns: str
    nodes: tuple[tuple[str, str | None], ...]  # (column, class or None); a NULL value has no node
    facts: tuple[Fact, ...]
    label_predicate: str = RDFS_LABEL
    nested: Nested | None = None
    local: str | None = None  # the page column: facts whose first key it is depend on one page only


def _all_present(names: tuple[str, ...]) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names) or "true"


def graph_to_triples(df: DataFrame, graph: Graph) -> DataFrame:
    """The set of triples of all rows.

    Facts of one page (``graph.local``) are apart from facts that pages share: a page is one narrow row in one shuffle and
    is expanded after it, and only the shared nodes and facts are combined triple by triple. The input is read once, for
    the columns of the graph: texts that only their digests are taken of are joined and shuffled no second time.
    """
    if graph.local is None:
        return _fact_triples(df, graph)
    df = stored(df.select(*_graph_columns(graph)), "graph-rows")

    def part(local: bool) -> Graph:
        def own(facts: tuple[Fact, ...]) -> tuple[Fact, ...]:
            return tuple(f for f in facts if (f.keys[0] == graph.local) == local)

        nested = graph.nested
        if nested:
            nested = Nested(nested.column, nested.fields, lambda entry: own(graph.nested.facts(entry)))
            nested = nested if nested.facts("") else None
        return Graph(graph.ns, () if local else graph.nodes, own(graph.facts), graph.label_predicate, nested)

    shared = part(False)
    pages = _page_triples(df, part(True), graph.local)
    return pages.unionByName(_fact_triples(df, shared)) if shared.nodes or shared.facts or shared.nested else pages


def _graph_columns(graph: Graph) -> list[str]:
    """The columns of the input that a graph is made of."""
    nested = graph.nested
    facts = [*graph.facts, *(nested.facts("") if nested else ())]
    columns = {column for column, _ in graph.nodes} | {k for f in facts for k in (*f.keys, *f.required)}
    columns |= {graph.local} if graph.local else set()
    return sorted(columns - set(nested.fields) | {nested.column}) if nested else sorted(columns)


_NO_TRIPLES = f"CAST(array() AS array<struct<{', '.join(f'{c}: string' for c in TRIPLE_COLUMNS)}>>)"


def _page_triples(df: DataFrame, graph: Graph, page: str) -> DataFrame:
    """Triples of the facts about one page.

    All rows of a page are combined per task to the smallest and the largest of them. If both are equal, and they are
    for pages that come once or as copies, this row says all about the page. Pages with different rows, of which one may
    have very many, are few; their rows go the way of shared facts.
    """
    nested = graph.nested
    fields = set(nested.fields) if nested else set()
    columns = sorted({k for f in graph.facts for k in f.keys} - {page} - fields)
    row = F.struct(*columns, *([nested.column] if nested else []), F.lit(0).alias("_any"))
    pages = df.groupBy(page).agg(F.min(row).alias("low"), F.max(row).alias("high"))
    pages = stored(pages.select(page, "low", F.col("low").eqNullSafe(F.col("high")).alias("same")), "pages")
    many = pages.where("NOT same").select(F.col(page).alias("_page"))

    def triples(f: Fact) -> str:
        made = f.array(Triple.struct)
        return f"IF({_all_present(f.required)}, {made}, {_NO_TRIPLES})" if f.required else made

    arrays = [triples(f) for f in graph.facts]
    if nested:
        each = ", ".join(map(triples, nested.facts("e.")))
        arrays.append(f"coalesce(flatten(transform({nested.column}, e -> concat({each}))), {_NO_TRIPLES})")
    whole = pages.where("same").select(page, "low.*")
    out = whole.selectExpr(f"inline(array_distinct(concat({', '.join(arrays)})))")
    if many.isEmpty():
        return out
    rows = df.join(many, F.col(page).eqNullSafe(F.col("_page")), "left_semi")
    return out.unionByName(_fact_triples(rows, graph))


def _fact_triples(df: DataFrame, graph: Graph) -> DataFrame:
    """The set of triples of all rows, in one shuffle on the fact keys.

    Repeated facts (a label, a language, a source) are combined per task before the shuffle, so a value shared by
    most rows is not hot. A node is one entry whatever its classes are: they travel as bits and are combined with
    ``bit_or``, which keeps the label of a value that occurs under two classes single.
    """
    nested = graph.nested
    nested_facts = nested.facts("") if nested else ()
    facts = [*graph.facts, *nested_facts]
    columns = sorted({k for f in facts for k in f.keys})
    classes = list(dict.fromkeys(cls for _, cls in graph.nodes if cls))

    def entry(number: int, value: str, bits: int, keys: tuple[str, ...], present: tuple[str, ...]) -> str:
        def place(column: str) -> str:
            return f"e.{column}" if nested and column in nested.fields else column

        fields = [f"'fact', {number}", f"'node_value', CAST({value} AS STRING)", f"'bits', {bits}L"]
        fields += [f"'{c}', CAST({place(c) if c in keys else 'NULL'} AS STRING)" for c in columns]
        struct = f"named_struct({', '.join(fields)})"
        return f"IF({_all_present(present)}, {struct}, NULL)" if present else struct

    entries = [
        entry(-1, column, 1 << classes.index(cls) if cls else 0, (), (column,)) for column, cls in graph.nodes
    ]
    entries += [entry(i, "NULL", 0, f.keys, f.required) for i, f in enumerate(graph.facts)]
    listed = [f"array_compact(array({', '.join(entries)}))"] if entries else []
    if nested:
        start = len(graph.facts)
        per_element = ", ".join(entry(start + i, "NULL", 0, f.keys, f.required) for i, f in enumerate(nested_facts))
        listed.append(f"flatten(transform({nested.column}, e -> array({per_element})))")
    distinct = (
        df.selectExpr(f"inline(concat({', '.join(listed)}))")
        .groupBy("fact", "node_value", *columns)
        .agg(F.bit_or("bits").alias("bits"))
    )
    entity = node(graph.ns, "node_value")
    described = [literal_triple(entity, graph.label_predicate, "node_value").struct()]
    described += [
        f"IF(bits & {1 << i}L != 0, {type_triple(entity, graph.ns + cls).struct()}, NULL)"
        for i, cls in enumerate(classes)
    ]
    branches = [f"WHEN -1 THEN array_compact(array({', '.join(described)}))"] if graph.nodes else []
    branches += [f"WHEN {i} THEN {f.array(Triple.struct)}" for i, f in enumerate(facts)]
    return distinct.selectExpr(f"inline(CASE fact {' '.join(branches)} END)")


def graph_lines(graph: Graph) -> Column:
    """The distinct statements of one row as an array of text, without a shuffle."""
    described = []
    for column, cls in graph.nodes:
        entity = node(graph.ns, column)
        triples = [literal_triple(entity, graph.label_predicate, column)]
        if cls:
            triples.append(type_triple(entity, graph.ns + cls))
        described.append(fact((column,), *triples, required=(column,)))
    none = "CAST(array() AS array<string>)"
    arrays = []
    for f in [*described, *graph.facts]:
        lines = f.array(Triple.line)
        arrays.append(f"IF({_all_present(f.required)}, {lines}, {none})" if f.required else lines)
    if graph.nested:
        per_element = ", ".join(f.array(Triple.line) for f in graph.nested.facts("e."))
        arrays.append(f"flatten(transform({graph.nested.column}, e -> concat({per_element})))")
    return F.expr(f"array_distinct(concat({', '.join(arrays)}))")


def document_text(lines: Column) -> Column:
    """Sorted statements joined by newlines."""
    return F.array_join(F.sort_array(lines), "\n")


def ntriples(triples: DataFrame) -> DataFrame:
    """One statement per triple in the column ``line``."""
    subject = "IF(startswith(s, '_:'), s, concat('<', s, '>'))"
    target = f"CASE o_kind WHEN 'iri' THEN concat('<', o, '>') WHEN 'bnode' THEN o ELSE {_literal('o', 'o_datatype')} END"
    return triples.selectExpr(f"concat({subject}, ' <', p, '> ', {target}, ' .') AS line")


def merge_triples(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two graphs with set semantics."""
    return existing.unionByName(new).distinct()


# Folders of a stored graph: custom keys share the first one, other predicates are dealt to the rest. Their number does
# not depend on the data.
PREDICATE_GROUPS = 16
_GROUP, _DIGEST = "p_group", "digest"
_TRIPLE_DDL = ", ".join(f"{c} string" for c in TRIPLE_COLUMNS)


def predicate_group(predicate: Column) -> Column:
    """The folder of a predicate."""
    hashed = (F.pmod(F.xxhash64(predicate), F.lit(PREDICATE_GROUPS - 1)) + 1).cast("int")
    return F.when(F.regexp_substr(predicate, F.lit("[^/#]*$")).startswith("cf_"), 0).otherwise(hashed)


def triple_digest() -> Column:
    """128 bits of the sha256 of all parts of a triple."""
    parts = F.to_json(F.struct(*TRIPLE_COLUMNS))  # absent parts are left out, so NULL is not an empty text
    return F.unhex(F.left(F.sha2(parts, 256), F.lit(32)))


def write_triples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a graph with a folder per predicate, so that a pattern reads only the triples of its predicate. A graph with
    custom keys has as many predicates as keys; ``TripleStore`` bounds the folders."""
    triples.select(*TRIPLE_COLUMNS).write.mode(mode).partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """A written graph or a store."""
    return spark.read.schema(TRIPLE_SCHEMA).parquet(path).select(*TRIPLE_COLUMNS)


@contextmanager
def _store_table(spark: SparkSession, path: str, buckets: int) -> Iterator[str]:
    """The files of a store as a bucketed table. The name exists only inside the block; the files stay."""
    name = f"triples_{uuid.uuid4().hex}"
    columns = f"{_TRIPLE_DDL}, {_DIGEST} binary, {_GROUP} int"
    location = path.replace("'", "\\'")
    make_folder(spark, path)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({_GROUP}) "
        f"CLUSTERED BY ({_DIGEST}) SORTED BY ({_DIGEST}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    try:
        if spark.conf.get("spark.sql.hive.manageFilesourcePartitions") == "true":
            spark.catalog.recoverPartitions(name)
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")  # an external table: its files are not touched


class TripleStore:
    """A graph laid out for imports: bucketed by the digest of a triple inside its predicate group.

    An import deals only the new graph to the buckets; the store is read bucket by bucket where it lies and is never
    shuffled. ``buckets`` belongs to the store and must be the same whenever it is opened; choose it so that a bucket of
    digests (16 bytes a triple) fits a task. The session catalog holds a table name for as long as an import runs.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _write(self, fresh: DataFrame, name: str) -> None:
        """Write triples that are dealt to the buckets: the one task of a bucket writes one file per group."""
        rows = fresh.select(*TRIPLE_COLUMNS, _DIGEST, predicate_group(F.col("p")).alias(_GROUP))
        writer = rows.write.mode("append").format("parquet").partitionBy(_GROUP)
        writer.bucketBy(self.buckets, _DIGEST).sortBy(_DIGEST).option("path", self.path).saveAsTable(name)

    def held(self, name: str) -> DataFrame:
        """The digests of the store, in its buckets."""
        return self.spark.table(name).select(_DIGEST)

    def new_triples(self, new: DataFrame, name: str) -> DataFrame:
        """The distinct triples of ``new`` with their digest that the store does not hold yet, dealt to the buckets."""
        fresh = new.select(*TRIPLE_COLUMNS, triple_digest().alias(_DIGEST))
        fresh = fresh.repartition(self.buckets, _DIGEST).dropDuplicates([_DIGEST])
        return fresh.join(self.held(name).hint("merge"), _DIGEST, "left_anti")

    def append(self, new: DataFrame) -> None:
        """Import a graph; only what is new is written, in the tasks that have found it. The files of the store are listed
        before the first of them is written."""
        with _store_table(self.spark, self.path, self.buckets) as name:
            self._write(self.new_triples(new, name), name)

    def read(self, predicates: Sequence[str] | None = None) -> DataFrame:
        """All triples, or those of some predicates from their folders."""
        rows = self.spark.read.schema(f"{_TRIPLE_DDL}, {_GROUP} int").parquet(self.path)
        if predicates is not None:
            wanted = [predicate_group(F.lit(p)) for p in predicates]
            groups = self.spark.range(1).select(F.array(*wanted)).first()[0]
            rows = rows.where(F.col(_GROUP).isin(groups) & F.col("p").isin(list(predicates)))
        return rows.select(*TRIPLE_COLUMNS)
