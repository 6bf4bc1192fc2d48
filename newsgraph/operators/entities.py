"""Named-entity extraction: field choice, rules, gazetteer, and a plug-in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions import NULL_TEXT
from newsgraph.schema import ENTITY_COLUMNS
from newsgraph.session import stored

DEFAULT_FIELDS = ("title", "body")

# Fixed rules of the default extractor: entity label -> pattern. They stand in where no model is installed.
DEFAULT_RULES = {
    "MISC": r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
WORD = r"[\p{L}\p{Nd}]+"
REACH = 3  # words on either side of its anchor pair that are compared when a term meets a text

# texts -> one list of (entity, label) per text
Extractor = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, str]]]]


def text_fields(df: DataFrame, all_text: bool = False) -> list[str]:
    """Fields to search: title and body, or every text column that is not a hash."""
    if not all_text:
        return [c for c in DEFAULT_FIELDS if c in df.columns]
    return [name for name, kind in df.dtypes if kind == "string" and not name.endswith("_hash")]


def input_fields(df: DataFrame, fields: Sequence[str] | None = None, all_text: bool = False) -> DataFrame:
    """One row per article and non-missing text field."""
    chosen = list(fields) if fields is not None else text_fields(df, all_text)
    entries = F.array(*[F.struct(F.lit(c).alias("source_column"), F.col(c).alias("text")) for c in chosen])
    rows = df.select("article_id", "url_hash", "publication_date", F.inline(entries))
    return rows.where(F.col("text").isNotNull() & (F.col("text") != NULL_TEXT))


def _found(rows: DataFrame, found: Column) -> DataFrame:
    """Explode an array of (entity, entity_label); repeats within a field are dropped inside the row."""
    return rows.select(
        "article_id", "url_hash", "source_column", "publication_date", F.inline(F.array_distinct(found))
    ).select(*ENTITY_COLUMNS)


def rule_entities(
    df: DataFrame, rules: Mapping[str, str] = DEFAULT_RULES, fields: Sequence[str] | None = None
) -> DataFrame:
    """Distinct pattern matches per article and field. Built-in expressions only; no shuffle."""

    def matches(label: str, pattern: str) -> Column:
        texts = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        return F.transform(texts, lambda t: F.struct(t.alias("entity"), F.lit(label).alias("entity_label")))

    found = F.concat(*[matches(label, pattern) for label, pattern in rules.items()])
    return _found(input_fields(df, fields), found)


def _cut_words(column: str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def anchored_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Give each term (``entity, entity_label, term_words``) its rarest word as ``anchor``, the number of that word in
    the term as ``at``, and in how many texts it occurs as ``frequency``.

    ``words`` has a row per text and word of it. A term with a word that no text has cannot be found and is left out.
    """
    frequency = words.groupBy("word").agg(F.count("*").alias("frequency"))
    places = terms.select("*", F.posexplode("term_words").alias("at", "word")).join(frequency, "word", "left")
    rarest = F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("word").alias("anchor"), "at"))
    chosen = places.groupBy("entity", "entity_label", "term_words").agg(rarest.alias("rarest"))
    return chosen.select("entity", "entity_label", "term_words", "rarest.*").where("frequency > 0")


def gazetteer_entities(df: DataFrame, gazetteer: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Distinct gazetteer terms (``entity, entity_label``) found as whole words, case ignored.

    Terms and texts are cut into words alike, so "U.S. Senate" is found as the words u, s, senate; terms may have any
    number of words, terms without words are never found. The words of the texts are first filtered to those of the
    terms; counting them gives each term its rarest word, by which alone it meets a text (a term of several words
    together with the word beside it). The words around that place are then compared with the term by position; terms
    that reach further than REACH words are looked up in the whole text at the end. There is no broadcast hint: Spark
    broadcasts the terms when their measured size is under its threshold and otherwise joins by shuffle, where the
    adaptive skew join splits a frequent anchor.
    """
    texts = input_fields(df, fields).withColumns({"words": _cut_words("text"), "row": F.monotonically_increasing_id()})
    rows = stored(texts.where(F.size("words") > 0).drop("text"), "gazetteer-texts")  # fixes the row numbers
    words, n, at = F.col("term_words"), F.size("term_words"), F.col("at")
    terms = gazetteer.select("entity", "entity_label", _cut_words("entity").alias("term_words")).where(n > 0).distinct()
    vocabulary = terms.select(F.explode("term_words").alias("word")).distinct()
    own = rows.select("row", F.explode(F.array_distinct("words")).alias("word"))
    own = stored(own.join(vocabulary, "word", "left_semi"), "gazetteer-words")

    anchored = stored(anchored_terms(own, terms), "gazetteer-terms")
    single = anchored.where(n == 1).select("entity", "entity_label", F.col("anchor").alias("word"))
    found = own.join(single, "word").select("row", "entity", "entity_label")

    first = F.greatest(F.least(at, n - 2), F.lit(0))  # the anchor and the word after it, or the one before the last word
    skipped = F.greatest(first - REACH, F.lit(0))
    several = anchored.where(n > 1).select(
        "entity",
        "entity_label",
        F.concat_ws(" ", F.slice(words, first + 1, 2)).alias("pair"),
        (first - skipped).alias("ahead"),
        F.slice(words, skipped + 1, first - skipped + 2 + REACH).alias("near"),
        F.when((skipped > 0) | (n > first + 2 + REACH), F.concat_ws(" ", words)).alias("whole"),
    )
    places = rows.select("row", "words", F.posexplode("words").alias("at", "word")).where(at < F.size("words") - 1)
    skipped = F.greatest(at - REACH, F.lit(0))
    places = places.select(
        "row",
        F.concat("word", F.lit(" "), F.get("words", at + 1)).alias("pair"),
        (at - skipped).alias("before"),
        F.slice("words", skipped + 1, at - skipped + 2 + REACH).alias("context"),
    )
    begin = F.col("before") - F.col("ahead")
    same = F.slice("context", F.greatest(begin, F.lit(0)) + 1, F.size("near")) == F.col("near")
    met = places.join(several, "pair").where((begin >= 0) & same).select("row", "entity", "entity_label", "whole").distinct()
    text = F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" "))
    holds = text.contains(F.concat(F.lit(" "), F.col("whole"), F.lit(" ")))
    long_terms = met.where("whole IS NOT NULL").join(rows.select("row", "words"), "row").where(holds)
    found = found.union(met.where("whole IS NULL").drop("whole")).union(long_terms.select(found.columns))
    return found.join(rows.drop("words"), "row").select(*ENTITY_COLUMNS)


def model_entities(
    df: DataFrame,
    extractor_factory: Callable[[], Extractor],
    fields: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Entities from a user's model, run in Arrow batches.

    ``extractor_factory`` is called once per partition, so a model is loaded once and not per text.
    ``partitions`` deals the texts out evenly before the model runs, so copies of one article do not meet in a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = extractor_factory()
        for batch in batches:
            found = [list(dict.fromkeys(entities)) for entities in extract(batch["text"].tolist())]
            source = batch.loc[batch.index.repeat([len(entities) for entities in found])]
            pairs = [pair for entities in found for pair in entities]
            columns = {c: source[c].tolist() for c in ENTITY_COLUMNS if c in source}
            columns["entity"] = [entity for entity, _ in pairs]
            columns["entity_label"] = [label for _, label in pairs]
            yield pd.DataFrame({c: columns[c] for c in ENTITY_COLUMNS}, dtype="object")

    rows = input_fields(df, fields)
    if partitions is not None:
        rows = rows.repartition(partitions)
    return rows.mapInPandas(run, ", ".join(f"{c} string" for c in ENTITY_COLUMNS))


def distinct_entities(entities: DataFrame) -> DataFrame:
    """Set of entity rows over all articles."""
    return entities.distinct()
