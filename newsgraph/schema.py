"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


MANDATORY_COLUMNS = ["body", "url", "label", "title", "file_name"]
SUPPLEMENTARY_COLUMNS = [
    "publication_date",
    "author",
    "detailed_news_label",
    "language",
    "classification_date",
    "country_of_origin",
]
HASHED_COLUMNS = ["body", "url", "title", "file_name", "author"]

# Standard article table: one row per article and load, append only.
ARTICLE_COLUMNS = [
    "etl_timestamp",
    *MANDATORY_COLUMNS,
    *SUPPLEMENTARY_COLUMNS,
    "custom_columns",
    *[f"{c}_hash" for c in HASHED_COLUMNS],
    "article_id",
]
ARTICLE_SCHEMA = T.StructType(
    [T.StructField("etl_timestamp", T.TimestampType())] + _strings(ARTICLE_COLUMNS[1:]).fields
)

# One record of the cleaned multi-line CSV.
RECORD_COLUMNS = [
    "idx",
    "news_id",
    "domain",
    "label",
    "url",
    "body",
    "scraped_at",
    "inserted_at",
    "updated_at",
    "title",
]
RECORD_SCHEMA = _strings(RECORD_COLUMNS)

# Side-car record of one URL.
SIDECAR_COLUMNS = ["url", "domain", "domain_hash", "title_hash", "title", "body_hash", "body", "label"]
SIDECAR_SCHEMA = _strings(SIDECAR_COLUMNS)

TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_datatype"]
TRIPLE_SCHEMA = _strings(TRIPLE_COLUMNS)

ENTITY_COLUMNS = ["article_id", "url_hash", "source_column", "entity", "entity_label", "publication_date"]
