"""SQL twins of the registered queries, written for DuckDB over the same tables.

They compute the results directly from the tables and share no code with the package.
"""

from __future__ import annotations

NS = "https://newsgraph.example/ns#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

RAW = """
raw AS (
  SELECT d.doc_id, d.text, split_part(d.text, chr(10), 1) AS title, p.url AS site_url,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'reliable' WHEN l.quality = 0 AND l.toxic = 0 THEN 'unreliable'
         WHEN l.quality = 1 AND l.toxic = 1 THEN 'bias' WHEN l.quality = 0 AND l.toxic = 1 THEN 'hate' END AS type,
    d.source AS file_name, d.lang AS language, d.n_chars, p.page_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
)"""


def _null(column: str) -> str:
    return f"coalesce(nullif(CAST({column} AS VARCHAR), ''), 'null')"


ART = (
    RAW
    + f""",
mapped AS (
  SELECT doc_id, type, {_null("text")} AS body, {_null("site_url")} AS url, {_null("type")} AS label,
    {_null("title")} AS title, {_null("file_name")} AS file_name, 'null' AS publication_date, 'null' AS author,
    'null' AS detailed_news_label, {_null("language")} AS language, 'null' AS classification_date,
    'null' AS country_of_origin, n_chars, page_id,
    CAST(json_object('n_chars', n_chars, 'page_id', page_id, 'shares', 'null') AS VARCHAR) AS custom_columns
  FROM raw
),
art AS (
  SELECT *, sha256(body) AS body_hash, sha256(url) AS url_hash, sha256(title) AS title_hash,
    sha256(file_name) AS file_name_hash, sha256(author) AS author_hash,
    sha256(title) || sha256(body) AS article_id,
    sha256(title) || sha256(body) || '_' || sha256(url) AS webpage
  FROM mapped
)"""
)

# Articles with every supplementary column, where a customer has the article's number.
FULL = (
    ART.replace("'null' AS publication_date", _null("strftime(first_day, '%Y-%m-%dT%H:%M:%S')") + " AS publication_date")
    .replace("'null' AS classification_date", _null("strftime(last_day, '%Y-%m-%dT%H:%M:%S')") + " AS classification_date")
    .replace(
        "'null' AS author",
        _null("c_name || ' of Desk ' || c_mktsegment[1] || lower(c_mktsegment[2:])") + " AS author",
    )
    .replace("'null' AS detailed_news_label", _null("c_mktsegment") + " AS detailed_news_label")
    .replace("'null' AS country_of_origin", _null("n_name") + " AS country_of_origin")
    .replace(
        "  FROM raw\n",
        """  FROM raw LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1)
      ON o_custkey = doc_id
""",
    )
)

LOADS = (
    ART
    + """,
loads AS (
  SELECT * REPLACE ('null' AS label), '2024-01-01 00:00:00' AS etl_timestamp FROM art
  UNION ALL
  SELECT *, '2024-02-01 00:00:00' AS etl_timestamp FROM art WHERE type IS NOT NULL
)"""
)

UNIQUE = (
    LOADS
    + """,
uniq AS (
  SELECT * FROM loads QUALIFY row_number() OVER (
    PARTITION BY article_id, url ORDER BY etl_timestamp DESC, label, file_name, custom_columns) = 1
)"""
)

WEB = (
    RAW
    + """,
web AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS idx, CAST(doc_id AS VARCHAR) AS news_id,
    CASE WHEN site_url IS NULL THEN file_name ELSE regexp_extract(site_url, '^[a-z]+://([^/?#]+)', 1) END AS domain,
    coalesce(type, 'unknown') AS label, coalesce(site_url, file_name || '/' || doc_id) AS url, text AS body,
    '2018-01-25 16:17:44.789555' AS scraped_at, '2018-02-02 01:19:41.756632' AS inserted_at,
    '2018-02-02 01:19:41.756664' AS updated_at, title
  FROM raw
),
webh AS (
  SELECT *, md5(url) AS url_hash, 'domain_' || md5(domain) AS domain_hash, 'title_' || md5(title) AS title_hash,
    'body_' || md5(body) AS body_hash
  FROM web
)"""
)

COMPLETE_WEB = WEB.replace(
    "  FROM raw\n", "  FROM raw WHERE site_url IS NOT NULL AND type IS NOT NULL AND text IS NOT NULL\n"
)

RECORD = (
    """idx || ',' || news_id || ',' || domain || ',' || label || ',' || url || ',"' || body || '",' || scraped_at"""
    """ || ',' || inserted_at || ',' || updated_at || ',"' || title || '","Unknown","",""'"""
)

# The record checks again, over the rendered text.
PARSED = (
    WEB
    + f""",
rendered AS (SELECT {RECORD} AS record FROM web),
split1 AS (SELECT record, string_split(record, '"') AS parts FROM rendered),
split2 AS (
  SELECT *, string_split(parts[1], ',') AS head,
    coalesce(list_position(list_transform(parts,
      lambda x: regexp_matches(x, '^,?\\d\\d\\d\\d-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d.\\d+')), true), 0) AS pos
  FROM split1
),
split3 AS (
  SELECT *, list_filter(string_split(parts[pos], ','),
      lambda x: regexp_matches(x, '\\d\\d\\d\\d-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d.\\d+')) AS stamps,
    parts[pos + 1] AS ptitle
  FROM split2
),
parsed AS (
  SELECT *, CASE
    WHEN len(parts) < 3 THEN 'R1' WHEN len(head) <> 6 THEN 'R2' WHEN pos < 2 THEN 'R3'
    WHEN len(stamps) <> 3 THEN 'R4' WHEN ptitle IS NULL THEN 'R5'
    WHEN regexp_matches(ptitle, '^\\[') AND regexp_matches(ptitle, '\\]$') THEN 'R6'
    WHEN length(ptitle) <= 10 THEN 'R7'
    WHEN length(regexp_replace(ptitle, '\\P{{Nd}}', '', 'g')) / length(ptitle) > 0.5 THEN 'R8'
    WHEN list_sum(list_transform(string_split(ptitle, ','), lambda x: len(string_split(x, ' '))))
         / len(string_split(ptitle, ',')) <= 3 THEN 'R9' END AS reason
  FROM split3
),
accepted AS (
  SELECT head[1] AS idx, head[2] AS news_id, head[3] AS domain, head[4] AS label, head[5] AS url,
    array_to_string(parts[2:pos - 1], '') AS body, stamps[1] AS scraped_at, stamps[2] AS inserted_at,
    stamps[3] AS updated_at, ptitle AS title
  FROM parsed WHERE reason IS NULL
)"""
)

DAMAGED = (
    """CASE doc_id % 7 WHEN 1 THEN concat_ws(',', idx, news_id, domain, label, url, 'lost')
  WHEN 2 THEN concat_ws(',', idx, news_id, label, url, '"' || body || '"', scraped_at, inserted_at, updated_at, '"' || title || '"', '"Unknown","",""')
  WHEN 3 THEN concat_ws(',', idx, news_id, domain, label, url, '"' || body || '"', 'soon', '"' || title || '"', '"Unknown","",""')
  WHEN 4 THEN concat_ws(',', idx, news_id, domain, label, url, '"' || body || '"', scraped_at, inserted_at, '"' || title || '"', '"Unknown","",""')
  WHEN 5 THEN concat_ws(',', idx, news_id, domain, label, url, '"' || body || '"', scraped_at, inserted_at, updated_at)
  WHEN 6 THEN concat_ws(',', idx, news_id, domain, label, url, '"' || body || '"', scraped_at, inserted_at, updated_at, '"[' || title || ']"', '"Unknown","",""')
  ELSE """
    + RECORD
    + " END"
)
DAMAGED_PARSED = PARSED.replace(RECORD, DAMAGED)

RECORD_COLUMNS = "idx, news_id, domain, label, url, body, scraped_at, inserted_at, updated_at, title"


def quote(column: str) -> str:
    return f"replace(url_encode({column}), '%2F', '/')"


def _row(s: str, p: str, o: str, kind: str, datatype: str = "NULL") -> str:
    return (
        f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, CAST({datatype} AS VARCHAR) AS o_datatype"
    )


def _blank(key: str, predicate: str) -> str:
    return f"'_:b' || sha256({key} || '|{predicate}')"


def article_graph(source: str) -> str:
    """Triples of article rows, as a set."""
    pub = f"'{NS}' || webpage"
    rows = [
        _row(pub, TYPE, f"'{NS}publication'", "iri") + f" FROM {source}",
        _row(pub, LABEL, "webpage", "literal") + f" FROM {source}",
        _row(pub, NS + "turtleFile", "sha256(webpage)", "literal", f"'{XSD}string'") + f" FROM {source}",
    ]
    linked = [
        ("body_hash", "bodyHash", "has_body_hash"),
        ("file_name_hash", "infoSource", "is_sourced_from"),
        ("label", "classification", "has_classification"),
        ("title_hash", "title", "has_title_hash"),
        ("url_hash", "urlHash", "has_url_hash"),
        ("author_hash", "author", "authored_by"),
        ("country_of_origin", "country", "is_from_country"),
        ("language", "language", "is_in_language"),
    ]
    for column, cls, predicate in linked:
        entity = f"'{NS}' || {quote(column)}"
        blank = _blank("webpage", predicate)
        known, missing = f" FROM {source} WHERE {column} <> 'null'", f" FROM {source} WHERE {column} = 'null'"
        rows += [
            _row(entity, TYPE, f"'{NS}{cls}'", "iri") + known,
            _row(entity, LABEL, column, "literal") + known,
            _row(pub, NS + predicate, entity, "iri") + known,
            _row(blank, TYPE, f"'{NS}{cls}'", "iri") + missing,
            _row(blank, LABEL, blank, "bnode") + missing,
            _row(pub, NS + predicate, blank, "bnode") + missing,
        ]
    for column, predicate in (("classification_date", "classifiedDate"), ("publication_date", "publishedDate")):
        known, missing = f" FROM {source} WHERE {column} <> 'null'", f" FROM {source} WHERE {column} = 'null'"
        rows += [
            _row(pub, NS + predicate, column, "literal", f"'{XSD}dateTime'") + known,
            _row(pub, NS + predicate, _blank("webpage", predicate), "bnode") + missing,
        ]
    return "\nUNION\n".join(rows)


def custom_graph(source: str) -> str:
    """Triples of the custom columns n_chars (always a number), page_id (number or null) and shares ('null')."""
    pub = f"'{NS}' || webpage"
    rows = [_row(pub, NS + "has_extra_class", f"'{NS}extraClass'", "iri") + f" FROM {source}"]
    for key in ("n_chars", "page_id", "shares"):
        term = f"{NS}cf_{key}"
        rows += [
            _row(f"'{term}'", TYPE, f"'{OWL}Class'", "iri") + f" FROM {source}",
            _row(f"'{term}'", TYPE, f"'{OWL}DataProperty'", "iri") + f" FROM {source}",
            _row(pub, NS + "has_extra_class", f"'{term}'", "iri") + f" FROM {source}",
        ]
        blank = _row(pub, term, _blank("webpage", key), "bnode") + f" FROM {source}"
        if key == "shares":
            rows.append(blank)
        else:
            value = _row(pub, term, f"CAST({key} AS VARCHAR)", "literal", f"'{XSD}integer'")
            rows += [value + f" FROM {source} WHERE {key} IS NOT NULL", blank + f" WHERE {key} IS NULL"]
    return "\nUNION\n".join(rows)


def _dates(subject: str) -> list[str]:
    return [
        _row(subject, NS + d, d, "literal", f"'{XSD}dateTime'") + " FROM webh"
        for d in ("scraped_at", "inserted_at", "updated_at")
    ]


def hashed_url_graph() -> str:
    url = f"'{NS}' || url_hash"
    rows = [
        _row(url, TYPE, f"'{NS}urlHash'", "iri") + " FROM webh",
        _row(url, LABEL, "url_hash", "literal") + " FROM webh",
    ]
    for column, cls, predicate in (
        ("label", "newsLabel", "has_news_label"),
        ("domain_hash", "domainHash", "has_domain_hash"),
        ("title_hash", "titleHash", "has_title_hash"),
        ("body_hash", "bodyHash", "has_body_hash"),
    ):
        entity = f"'{NS}' || {column}"
        rows += [
            _row(entity, TYPE, f"'{NS}{cls}'", "iri") + " FROM webh",
            _row(entity, LABEL, column, "literal") + " FROM webh",
            _row(url, NS + predicate, entity, "iri") + " FROM webh",
        ]
    return "\nUNION\n".join(rows + _dates(url))


def raw_url_graph(typed: bool) -> str:
    url = f"'{NS}' || {quote('url')}"
    label = LABEL if typed else NS + "label"
    title_node = f"'{NS}' || title_hash" if typed else f"'{NS}' || md5(title)"
    rows = [_row(url, NS + "has_url", "url", "literal") + " FROM webh"]
    nodes = [
        ("news_id", "newsId", f"'{NS}' || {quote('news_id')}"),
        ("label", "newsLabel", f"'{NS}' || {quote('label')}"),
        ("domain", "domain", f"'{NS}' || {quote('domain')}"),
        ("title", "title", title_node),
    ]
    for column, cls, entity in nodes:
        rows.append(_row(entity, label, column, "literal") + " FROM webh")
        if typed:
            rows.append(_row(entity, TYPE, f"'{NS}{cls}'", "iri") + " FROM webh")
    rows += [
        _row(url, NS + "has_id", nodes[0][2], "iri") + " FROM webh",
        _row(url, NS + "has_news_label", "label", "literal") + " FROM webh",
        _row(url, NS + "has_domain", nodes[2][2], "iri") + " FROM webh",
        _row(url, NS + "has_title", title_node, "iri") + " FROM webh",
        _row(url, NS + "has_body_hash", "body_hash" if typed else "md5(body)", "literal") + " FROM webh",
    ]
    if typed:
        rows += [
            _row(url, TYPE, f"'{NS}url'", "iri") + " FROM webh",
            _row(f"'{NS}' || body_hash", TYPE, f"'{NS}bodyHash'", "iri") + " FROM webh",
        ]
    return "\nUNION\n".join(rows + _dates(url))


def content_graph() -> str:
    news = f"'{NS}' || {quote('news_id')}"
    rows = [
        _row(news, NS + "label", "news_id", "literal") + " FROM webh",
        _row(f"'{NS}' || md5(title)", NS + "label", "title", "literal") + " FROM webh",
        _row(f"'{NS}' || md5(body)", NS + "label", "body", "literal") + " FROM webh",
        _row(news, NS + "has_title", f"'{NS}' || md5(title)", "iri") + " FROM webh",
        _row(news, NS + "has_content", f"'{NS}' || md5(body)", "iri") + " FROM webh",
    ]
    return "\nUNION\n".join(rows)


FIELDS = (
    ART
    + """,
fields AS (
  SELECT article_id, url_hash, publication_date, 'title' AS source_column, title AS text FROM art
  UNION ALL SELECT article_id, url_hash, publication_date, 'body', body FROM art
)"""
)

TEXT_COLUMNS = (
    "body", "url", "label", "title", "file_name", "publication_date", "author", "detailed_news_label", "language",
    "classification_date", "country_of_origin", "custom_columns", "article_id",
)
ALL_FIELDS = f"{FULL},\nfields AS (" + " UNION ALL ".join(
    f"SELECT article_id, url_hash, publication_date, '{c}' AS source_column, {c} AS text FROM art" for c in TEXT_COLUMNS
) + ")"

MISC = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _matches(pattern: str, label: str) -> str:
    return f"""
  SELECT article_id, url_hash, source_column, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS entity,
    '{label}' AS entity_label, publication_date FROM fields WHERE text <> 'null'"""


ENTITIES = FIELDS + f""",
ents AS ({_matches(MISC, "MISC")} UNION ALL {_matches(EMAIL, "EMAIL")}),
named AS (
  SELECT *, article_id || '_' || url_hash AS webpage,
    'NER_' || sha256(article_id || '_' || url_hash) || '_' || sha256(entity) || '_' || entity_label AS doc
  FROM ents
)"""


def entity_graph() -> str:
    pub, entity = f"'{NS}' || webpage", f"'{NS}' || {quote('entity')}"
    label, doc = f"'{NS}' || {quote('entity_label')}", f"'{NS}' || doc || '.ttl'"
    rows = [
        _row(pub, TYPE, f"'{NS}publication'", "iri"),
        _row(entity, TYPE, f"'{NS}ner_entity'", "iri"),
        _row(entity, LABEL, "entity", "literal"),
        _row(pub, NS + "has_ner_entity", entity, "iri"),
        _row(label, TYPE, f"'{NS}ner_label'", "iri"),
        _row(label, LABEL, "entity_label", "literal"),
        _row(entity, NS + "has_ner_label", label, "iri"),
        _row(doc, TYPE, f"'{NS}infoSource'", "iri"),
        _row(pub, NS + "is_sourced_from", doc, "iri"),
        _row(entity, NS + "is_sourced_from", doc, "iri"),
        _row(entity, NS + "ner_source", "source_column", "literal"),
    ]
    return "\nUNION\n".join(r + " FROM named" for r in rows)


def _usage(prelude: str, graph: str, terms: dict[str, list[str]]) -> str:
    values = ", ".join(f"('{NS}{t}', '{OWL}{group}')" for group, names in terms.items() for t in names)
    return f"""
WITH {prelude}, g AS ({graph}),
declared(s, o) AS (VALUES {values})
SELECT d.s, '{TYPE}' AS p, d.o,
  (SELECT count(*) FROM g WHERE CASE WHEN g.p = '{TYPE}' THEN g.o ELSE g.p END = d.s) AS n_uses
FROM declared d"""


# The declared terms of each graph form.
ARTICLE_TERMS = {
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
    "DataProperty": [
        "publishedDate",
        "classifiedDate",
        "turtleFile",
    ],
}
NER_TERMS = {
    "Class": [
        "publication",
        "ner_entity",
        "ner_label",
        "ner_source",
    ],
    "ObjectProperty": [
        "has_ner_entity",
        "has_ner_label",
        "has_url_hash",
        "is_in_language",
    ],
    "DataProperty": [
        "ner_source",
    ],
}
URL_TERMS = {
    "Class": [
        "titleHash",
        "domainHash",
        "urlHash",
        "newsLabel",
        "bodyHash",
    ],
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
    "DataProperty": [
        "scrapedDate",
        "insertedDate",
        "updatedDate",
    ],
}
URL_RAW_TERMS = {
    "Class": [
        "newsId",
        "title",
        "domain",
        "url",
        "newsLabel",
        "bodyHash",
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
    "DataProperty": [
        "scrapedDate",
        "insertedDate",
        "updatedDate",
    ],
}
URL_UNTYPED_TERMS = {
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
}
CONTENT_TERMS = {
    "Class": [
        "newsId",
        "title",
        "content",
        "contentHash",
    ],
    "ObjectProperty": [
        "has_title",
        "has_content",
        "has_content_hash",
    ],
    "DataProperty": [],
}

# One statement per triple, literals escaped.
LINE = (
    "CASE WHEN s LIKE '\\_:%' ESCAPE '\\' THEN s ELSE '<' || s || '>' END || ' <' || p || '> ' || "
    "CASE o_kind WHEN 'iri' THEN '<' || o || '>' WHEN 'bnode' THEN o ELSE "
    "'\"' || replace(replace(replace(replace(o, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r') || '\"' "
    "|| CASE WHEN o_datatype IS NULL THEN '' ELSE '^^<' || o_datatype || '>' END END || ' .'"
)


def _documents(prelude: str, graph: str, key: str) -> str:
    """Statements grouped by document: the graph rows carry the document name in ``key``."""
    with_key = graph.replace("SELECT ", f"SELECT {key} AS name, ")
    return f"""
WITH {prelude}, g AS ({with_key})
SELECT name, string_agg({LINE}, chr(10) ORDER BY {LINE}) AS document FROM g GROUP BY name"""


DATASETS = ", ".join(f"'src{i}'" for i in range(10))
OTHER_DATASETS = ", ".join(f"'src{i}'" for i in range(10, 18))
STATUS = (
    "CASE WHEN r.n IS NULL THEN 'left only' WHEN l.n IS NULL THEN 'right only' WHEN l.n = r.n THEN 'equal' "
    "ELSE 'different' END"
)

SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]*"
DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
INTEGER = rf"^{SPACE}[+-]?{DIGITS}{SPACE}$"
FLOAT = (
    rf"^(?i:{SPACE}[+-]?(?:(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:e[+-]?{DIGITS})?"
    rf"|nan|inf|infinity){SPACE})$"
)


def _text_profile(column: str, name: str) -> str:
    return f"""
SELECT '{name}' AS "column", (SELECT count({column}) FROM raw) AS "count", count(*) AS "unique",
  (SELECT {column} FROM raw WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, sha256({column})
   LIMIT 1) AS top,
  max(n) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS "min", NULL::DOUBLE AS q25,
  NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS "max"
FROM (SELECT {column}, count(*) AS n FROM raw WHERE {column} IS NOT NULL GROUP BY {column})"""


def _number_profile(column: str) -> str:
    return f"""
SELECT '{column}', count({column}), NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, round(avg({column}), 4),
  round(stddev_samp({column}), 4), round(min({column})::DOUBLE, 4), round(quantile_cont({column}, 0.25), 4),
  round(quantile_cont({column}, 0.5), 4), round(quantile_cont({column}, 0.75), 4), round(max({column})::DOUBLE, 4)
FROM raw"""


MEASURED = """
measured AS (
  SELECT event_id, event_type, value AS value_1a, CAST(json_extract(props, '$.k') AS DOUBLE) AS value_1b,
    round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6, 6) AS value_1c
  FROM events
)"""
MELTED = (
    MEASURED
    + """,
melted AS (
  SELECT event_id, event_type, 'value_1a' AS variable, value_1a AS value FROM measured
  UNION ALL SELECT event_id, event_type, 'value_1b', value_1b FROM measured
  UNION ALL SELECT event_id, event_type, 'value_1c', value_1c FROM measured
)"""
)

STANDARD = (
    "body, url, label, title, file_name, publication_date, author, detailed_news_label, language, "
    "classification_date, country_of_origin, custom_columns, body_hash, url_hash, title_hash, file_name_hash, "
    "author_hash, article_id"
)
DOMAIN_LABELS = "SELECT domain_hash, label, count(*) AS n FROM webh GROUP BY ALL"


def _contract_row(standard: str, source: str, required: bool, data_type: str | None, missing: str | None) -> str:
    status = "absent" if data_type is None else "present"
    kind = "NULL" if data_type is None else f"'{data_type}'"
    count = "count(*)" if missing is None else f"count(*) FILTER (WHERE {missing} IS NULL OR {missing} = '')"
    return (
        f"SELECT count(*) AS n_rows, '{standard}' AS standard_column, '{source}' AS source_column, "
        f"{str(required).lower()} AS required, CAST({kind} AS VARCHAR) AS data_type, '{status}' AS status, "
        f"{count} AS n_missing FROM raw"
    )


CONTRACT = "\nUNION ALL\n".join(
    [
        _contract_row("body", "text", True, "string", "text"),
        _contract_row("url", "site_url", True, "string", "site_url"),
        _contract_row("label", "type", True, "string", "type"),
        _contract_row("title", "title", True, "string", "title"),
        _contract_row("file_name", "file_name", True, "string", "file_name"),
        _contract_row("publication_date", "published", False, None, None),
        _contract_row("author", "author", False, None, None),
        _contract_row("detailed_news_label", "", False, None, None),
        _contract_row("language", "language", False, "string", "language"),
        _contract_row("classification_date", "", False, None, None),
        _contract_row("country_of_origin", "country", False, None, None),
    ]
)

SNAPSHOT = f"""
WITH {LOADS}
SELECT a.article_id, a.url, a.label, a.file_name, a.etl_timestamp FROM loads a
JOIN (SELECT article_id, url, max(etl_timestamp) AS etl_timestamp FROM loads GROUP BY ALL) l
  ON a.article_id = l.article_id AND a.url = l.url AND a.etl_timestamp = l.etl_timestamp"""

INGESTED = f"WITH {ART} SELECT '2024-01-01 00:00:00' AS etl_timestamp, {STANDARD} FROM art"

ALL_TEXT = [
    "body",
    "url",
    "label",
    "title",
    "file_name",
    "publication_date",
    "author",
    "detailed_news_label",
    "language",
    "classification_date",
    "country_of_origin",
    "custom_columns",
    "article_id",
]

ORACLE: dict[str, str] = {
    # ingestion
    "ingest_standard_articles": INGESTED,
    "incremental_ingest": INGESTED,
    "ingest_custom_json": f"""
WITH {ART} SELECT article_id, custom_columns, n_chars, page_id, 'null' AS shares FROM art""",
    "ingest_key_hashes": f"""
WITH {ART} SELECT article_id, body_hash, url_hash, title_hash, file_name_hash, author_hash, webpage AS webpage_id,
  sha256(webpage) AS document_name FROM art""",
    "ingest_multi_dataset": f"""
WITH {ART}
SELECT article_id, url, file_name,
  CASE WHEN file_name IN ({DATASETS}) THEN language ELSE 'null' END AS language,
  CASE WHEN file_name IN ({DATASETS}) THEN 'null' ELSE language END AS country_of_origin,
  CASE WHEN file_name IN ({DATASETS}) THEN custom_columns
       ELSE CAST(json_object('n_chars', n_chars) AS VARCHAR) END AS custom_columns
FROM art WHERE file_name IN ({DATASETS}, {OTHER_DATASETS})""",
    "ingest_rejects": f"""
WITH {RAW}
SELECT doc_id, file_name,
  CASE WHEN file_name = 'src18' THEN 'missing mandatory column: label' ELSE 'no mapping config' END AS reject_reason
FROM raw WHERE file_name NOT IN ({DATASETS}, {OTHER_DATASETS})""",
    "schema_contract": f"WITH {RAW} {CONTRACT}",
    "ingest_folder": f"""
WITH {RAW}, site AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site FROM pages)
SELECT 'documents.parquet' AS file_name, {_null("site_url")} AS url, {_null("type")} AS label, {_null("title")} AS title,
  {_null("language")} AS language, sha256({_null("text")}) AS body_hash,
  CAST(json_object('n_chars', n_chars) AS VARCHAR) AS custom_columns, NULL::VARCHAR AS reject_reason,
  NULL::VARCHAR AS "row"
FROM raw
UNION ALL
SELECT 'pages.parquet', {_null("url")}, {_null("site")}, {_null("url")}, 'null', sha256({_null("html")}), '{{}}', NULL, NULL
FROM site
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no mapping config',
  CAST(json_object('item_id', item_id, 'text', text, 'file_name', 'benchmark.parquet') AS VARCHAR)
FROM benchmark""",
    "ingest_dropped_datasets": f"""
WITH {RAW}, site AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site FROM pages)
SELECT '2024-02-01 00:00:00' AS etl_timestamp, 'documents.parquet' AS file_name, {_null("site_url")} AS url, {_null("type")} AS label, {_null("title")} AS title,
  {_null("language")} AS language, sha256({_null("text")}) AS body_hash,
  CAST(json_object('n_chars', n_chars) AS VARCHAR) AS custom_columns, NULL::VARCHAR AS reject_reason,
  NULL::VARCHAR AS "row"
FROM raw
UNION ALL
SELECT '2024-01-01 00:00:00', 'pages.parquet', {_null("url")}, {_null("site")}, {_null("url")}, 'null', sha256({_null("html")}), '{{}}', NULL, NULL
FROM site
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no mapping config',
  CAST(json_object('item_id', item_id, 'text', text, 'file_name', 'benchmark.parquet') AS VARCHAR)
FROM benchmark""",
    "ingest_two_streams": f"""
WITH {ART}, site AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site FROM pages)
SELECT file_name, url, label, title, language, body_hash FROM art
UNION ALL
SELECT 'pages', {_null("url")}, {_null("site")}, {_null("url")}, 'null', sha256({_null("html")}) FROM site""",
    "file_manifest": """
SELECT count(*) AS n_records, 0::BIGINT AS n_unlisted, 0::BIGINT AS n_too_large FROM documents""",
    "drop_empty_text": f"""
WITH {RAW}
SELECT count(*) AS n_before, 'text' AS column_name, count(text) AS n_after FROM raw
UNION ALL SELECT count(*), 'type', count(type) FROM raw
UNION ALL SELECT count(*), 'site_url', count(site_url) FROM raw""",
    # snapshots
    "latest_snapshot_join": SNAPSHOT,
    "latest_snapshot_window": f"""
WITH {UNIQUE} SELECT article_id, url, label, file_name, custom_columns, etl_timestamp FROM uniq""",
    "latest_snapshot_late": SNAPSHOT.replace("a.etl_timestamp FROM", "a.etl_timestamp, a.body FROM", 1),
    "latest_snapshot_late_unique": f"""
WITH {UNIQUE} SELECT article_id, url, label, file_name, custom_columns, etl_timestamp FROM uniq""",
    "append_then_snapshot": f"""
SELECT etl_timestamp, label, count(*) AS n_articles FROM ({SNAPSHOT}) GROUP BY ALL""",
    # cleaning
    "clean_record_assembly": f"WITH {WEB} SELECT {RECORD} AS record FROM web",
    "clean_parse": f"WITH {PARSED} SELECT {RECORD_COLUMNS} FROM accepted",
    "clean_damaged_reasons": f"""
WITH {DAMAGED_PARSED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n_records FROM parsed GROUP BY ALL""",
    "clean_damaged_records": f"""
WITH {DAMAGED_PARSED} SELECT record, reason AS reject_reason FROM parsed WHERE reason IS NOT NULL""",
    "clean_reject_reasons": f"""
WITH {PARSED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n_records FROM parsed GROUP BY ALL""",
    "clean_dedupe_last_wins": f"""
WITH {WEB}
SELECT {RECORD_COLUMNS} FROM (SELECT * REPLACE (md5(title) AS news_id) FROM web)
QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY doc_id DESC) = 1""",
    "key_fields_required": f"""
WITH {RAW}
SELECT doc_id, site_url AS url, regexp_extract(site_url, '^[a-z]+://([^/?#]+)', 1) AS domain, type AS label
FROM raw WHERE site_url IS NOT NULL AND type IS NOT NULL AND text IS NOT NULL""",
    "json_batch_roundtrip": f"WITH {PARSED} SELECT {RECORD_COLUMNS} FROM accepted",
    "json_sidecar": f"""
WITH {WEB}
SELECT url_hash, CAST(json_object(url_hash, json_object('url', url, 'domain', domain, 'domain_hash', domain_hash,
  'title_hash', title_hash, 'title', title, 'body_hash', body_hash, 'body', body, 'label', label)) AS VARCHAR) AS value
FROM webh QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY doc_id DESC) = 1""",
    "json_sidecar_flatten": f"""
WITH {WEB}
SELECT url_hash, url, domain, domain_hash, title_hash, title, body_hash, body, label
FROM webh QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY doc_id DESC) = 1""",
    # functions
    "fn_hashes": """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, 'body_' || md5(text) AS prefixed FROM documents""",
    "fn_iri_quote": f"""
SELECT doc_id, {quote("text")} AS quoted, {quote("source")} AS quoted_source FROM documents""",
    "fn_type_guess": f"""
WITH tokens AS (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents)
SELECT CASE WHEN token IN ('', 'null') THEN 'none' WHEN regexp_matches(token, '{INTEGER}') THEN 'integer'
    WHEN regexp_matches(token, '{FLOAT}') THEN 'float' ELSE 'string' END AS guess,
  count(*) AS n_tokens, count(DISTINCT token) AS n_distinct
FROM tokens GROUP BY guess""",
    "fn_namespace_strip": """
SELECT page_id, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) ELSE url END AS stripped
FROM pages""",
    # profiling
    "profile_row_count": "SELECT count(*) AS population_count FROM documents",
    "duplicate_urls": f"""
WITH {LOADS}, counted AS (SELECT url, count(*) AS url_count FROM loads GROUP BY url)
SELECT * FROM counted WHERE url_count > 1""",
    "distinct_urls": f"WITH {WEB} SELECT DISTINCT url_hash FROM webh",
    "preview_rows": f"WITH {WEB} SELECT url_hash, url, domain, label FROM webh ORDER BY url_hash LIMIT 10",
    "lookup_by_body_hash": f"""
WITH {WEB}
SELECT news_id, url, domain, label, body_hash, body FROM webh
WHERE body_hash = (SELECT body_hash FROM webh GROUP BY body_hash ORDER BY count(*) DESC, body_hash LIMIT 1)""",
    "type_distribution": f"""
WITH {RAW} SELECT type, count(*) AS n_articles FROM raw WHERE type IS NOT NULL GROUP BY type""",
    "domain_label_counts": f"WITH {WEB} SELECT domain_hash, label, count(*) AS n_articles FROM webh GROUP BY ALL",
    "domain_multi_label_flag": f"""
WITH {WEB}, dl AS ({DOMAIN_LABELS})
SELECT domain_hash, label, n AS n_articles,
  row_number() OVER (PARTITION BY domain_hash ORDER BY n DESC, label) > 1 AS domain_has_multiple_label FROM dl""",
    "label_summary": f"""
WITH {WEB}
SELECT label, count(*) AS url_count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS url_count_pct
FROM webh GROUP BY label""",
    "domains_per_label": f"""
WITH {WEB}, dl AS ({DOMAIN_LABELS})
SELECT label, count(domain_hash) AS domain_count,
  round(count(domain_hash) * 100.0 / sum(count(domain_hash)) OVER (), 6)::DOUBLE AS domain_count_pct
FROM dl GROUP BY label""",
    "reused_bodies": f"""
WITH {WEB}, top AS (
  SELECT body_hash, label, count(DISTINCT url_hash) AS url_count FROM webh GROUP BY ALL
  ORDER BY url_count DESC, body_hash, label LIMIT 50)
SELECT * FROM top WHERE url_count >= 2""",
    "reused_bodies_bag": f"""
WITH {WEB}
SELECT body_hash, label, count(*) AS url_count FROM webh GROUP BY ALL
ORDER BY url_count DESC, body_hash, label LIMIT 50""",
    "cross_domain_bodies": f"""
WITH {WEB}
SELECT body_hash, domain_hash, count(DISTINCT label) AS label_count FROM webh GROUP BY ALL
ORDER BY label_count DESC, body_hash, domain_hash LIMIT 50""",
    "cross_labelled_bodies": f"""
WITH {WEB}
SELECT body_hash, domain_hash, count(DISTINCT label) AS label_count FROM webh GROUP BY ALL HAVING count(DISTINCT label) > 1""",
    "reconcile_stores": f"""
WITH {ART},
l AS (SELECT webpage, count(*) AS n FROM art GROUP BY webpage),
r AS (SELECT DISTINCT webpage, 1 AS n FROM art WHERE type IS NOT NULL)
SELECT {STATUS} AS status, count(*) AS n_keys, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS left_rows,
  CAST(coalesce(sum(r.n), 0) AS BIGINT) AS right_rows
FROM l FULL JOIN r USING (webpage) GROUP BY 1""",
    "profile_columns": f"WITH {RAW} "
    + "\nUNION ALL\n".join(
        [_text_profile(c, c) for c in ("text", "title", "site_url", "type", "file_name", "language")]
        + [_number_profile(c) for c in ("doc_id", "n_chars", "page_id")]
    ),
    # graphs
    "triples_article": f"WITH {ART} {article_graph('art')}",
    "triples_all_columns": f"WITH {FULL} {article_graph('art')}",
    "triples_custom": f"WITH {ART} {custom_graph('art')}",
    "triples_url_centric": f"WITH {WEB} {hashed_url_graph()}",
    "triples_url_raw": f"WITH {WEB} {raw_url_graph(True)}",
    "triples_url_untyped": f"WITH {WEB} {raw_url_graph(False)}",
    "triples_news_content": f"WITH {WEB} {content_graph()}",
    "triples_ner": f"WITH {ENTITIES} {entity_graph()}",
    "triples_merge": f"""
WITH {LOADS}, g AS ({article_graph("loads")})
SELECT p, o_kind, count(*) AS n_triples FROM g GROUP BY ALL""",
    "triples_import": f"WITH {LOADS} {article_graph('loads')}",
    "records_graph": f"WITH {COMPLETE_WEB} {hashed_url_graph()}",
    "ontology_articles": _usage(ART, article_graph("art"), ARTICLE_TERMS),
    "ontology_ner": _usage(ENTITIES, entity_graph(), NER_TERMS),
    "ontology_url_centric": _usage(WEB, hashed_url_graph(), URL_TERMS),
    "ontology_url_raw": _usage(WEB, raw_url_graph(True), URL_RAW_TERMS),
    "ontology_url_untyped": _usage(WEB, raw_url_graph(False), URL_UNTYPED_TERMS),
    "ontology_news_content": _usage(WEB, content_graph(), CONTENT_TERMS),
    "bgp_count_urls": f"WITH {WEB} SELECT count(DISTINCT url_hash) AS url_count FROM webh",
    "bgp_domain_label": f"""
WITH {WEB}
SELECT '{NS}' || domain_hash AS domain_hash, '{NS}' || label AS label, count(DISTINCT url_hash) AS url_count
FROM webh GROUP BY 1, 2""",
    "bgp_domain_url_body_label": f"WITH {WEB} SELECT DISTINCT domain_hash, url_hash, body_hash, label FROM webh",
    "bgp_literal_label": f"""
WITH {WEB}
SELECT DISTINCT '{NS}' || {quote("url")} AS url, '{NS}' || {quote("domain")} AS domain
FROM webh WHERE label = 'reliable'""",
    "bindings_to_table": f"""
WITH {WEB} SELECT domain_hash, label, count(DISTINCT url_hash) AS url_count FROM webh GROUP BY 1, 2""",
    "turtle_documents": _documents(
        UNIQUE, article_graph("uniq") + "\nUNION\n" + custom_graph("uniq"), "sha256(webpage)"
    ),
    "documents_by_name": _documents(
        UNIQUE, article_graph("uniq") + "\nUNION\n" + custom_graph("uniq"), "sha256(webpage)"
    ),
    "texts_by_weight": f"""
WITH {FIELDS}
SELECT count(*) AS n_texts, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, 0::BIGINT AS n_heavy
FROM fields WHERE text <> 'null'""",
    "ner_documents": _documents(ENTITIES, entity_graph(), "doc"),
    "ntriples_export": f"WITH {WEB}, g AS ({content_graph()}) SELECT {LINE} AS line FROM g",
    # entities
    "ner_input_fields": f"WITH {ART} "
    + "\nUNION ALL\n".join(
        f"SELECT article_id, url_hash, '{c}' AS source_column, {c} AS text FROM art WHERE {c} <> 'null'"
        for c in ALL_TEXT
    ),
    "ner_rule_entities": f"WITH {ENTITIES} SELECT * FROM ents",
    "ner_entities": f"WITH {ENTITIES} SELECT DISTINCT * FROM ents",
    "ner_model_plugin": f"WITH {ENTITIES} SELECT * FROM ents WHERE entity_label = 'EMAIL'",
    "ner_all_fields": f"""
WITH {ALL_FIELDS}, ents AS ({_matches(MISC, "MISC")} UNION ALL {_matches(EMAIL, "EMAIL")}) SELECT * FROM ents""",
    "ner_gazetteer": f"""
WITH {FIELDS},
words AS (SELECT text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w FROM benchmark),
terms AS (
  SELECT array_to_string(w[i:i + n - 1], ' ') AS entity, array_to_string(w[i:i + n - 1], ' ') AS term, n
  FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 5) lengths(n))
  UNION SELECT text, array_to_string(w, ' '), len(w) FROM words WHERE len(w) > 0),
tokens AS (
  SELECT article_id, url_hash, source_column, publication_date,
    regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS w
  FROM fields WHERE text <> 'null'),
grams AS (
  SELECT article_id, url_hash, source_column, publication_date, unnest(list_distinct(list_concat(w,
    list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')),
    list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')),
    list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))))) AS term
  FROM tokens),
found AS (
  SELECT grams.* EXCLUDE (term), entity FROM grams JOIN terms ON grams.term = terms.term AND n <= 4
  UNION ALL
  SELECT tokens.* EXCLUDE (w), entity FROM tokens JOIN terms
  ON n > 4 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || term || ' '))
SELECT article_id, url_hash, source_column, entity, 'MISC' AS entity_label, publication_date FROM found""",
    # statistics and samples
    "bench_melt": f"WITH {MELTED} SELECT event_id, event_type, variable, value FROM melted",
    "bench_summary": f"""
WITH {MELTED}
SELECT event_type, variable, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std_dev,
  round(median(value), 4) AS median
FROM melted GROUP BY event_type, variable""",
    "bench_ols": f"""
WITH {MEASURED}
SELECT event_type, round(regr_slope(value_1a, value_1b), 6) AS slope,
  round(regr_intercept(value_1a, value_1b), 6) AS intercept, round(regr_r2(value_1a, value_1b), 6) AS r2,
  regr_count(value_1a, value_1b)::BIGINT AS n
FROM measured GROUP BY event_type""",
    "sample_fixed_size": "SELECT * FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 500",
}
