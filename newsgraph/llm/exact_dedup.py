"""Exact deduplication: 128-bit content hash, byte comparison inside the groups, one row of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import ascii_lower, by_position
from newsgraph.session import stored

_KEY = ["_md5", "_sha"]


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    return texts.withColumn("_md5", F.md5("_norm")).withColumn("_sha", F.sha2("_norm", 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are grouped by their 128-bit hash *and* their bytes, so texts whose hashes collide are separate groups.
    Copies are combined inside each task before the one shuffle of the texts: a text that a third of all rows
    repeat moves once per task. Rows find their group over the two content hashes alone; two different texts that
    share both would fail the job and never be merged.

    Defined results: a NULL text is the empty text. A NULL id never stays while the group has another id; a group
    of NULL ids only has ``keep_id`` NULL and counts as kept. Rows that repeat an id and its text are copies of each
    other and are all marked like the row that stays (``drop_copies`` keeps one of them). Empty input: no rows.
    """
    best = {"max": F.max, "min": F.min}[keep]
    texts = _hashed(docs, id_col, text_col)
    by_text = texts.groupBy("_md5", "_norm").agg(F.count("*").alias("group_size"), best("_id").alias("keep_id"))
    by_text = by_text.withColumn("_sha", F.sha2("_norm", 256))
    # One row per text, without the text; written once because two outputs read it.
    groups = stored(by_text.select(*_KEY, "group_size", "keep_id"), "exact_groups")
    groups = groups.groupBy(*_KEY).agg(
        F.when(F.count("*") == 1, F.max("group_size"))
        .otherwise(F.raise_error(F.lit("different texts share both content hashes")).cast("long"))
        .alias("group_size"),
        F.max("keep_id").alias("keep_id"),
    )
    rows = texts.select("_id", *_KEY)
    return rows.join(groups, _KEY).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts. Of rows that also
    share the id, any one stays."""
    found = stored(exact_groups(docs, id_col, text_col, keep), "exact_rows")
    stays = found.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n"))
    keys = stays.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_n")
    rows = by_position(docs)
    own_id, own_text = (F.col(rows.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    marked = rows.withColumn("_sha_row", F.sha2(normalised(own_text), 256))
    kept = marked.join(keys, own_id.eqNullSafe(F.col("_id")) & (F.col("_sha_row") == F.col("_sha")))
    single = kept.filter("_n = 1").select(*rows.columns)
    if not keys.filter("_n > 1").isEmpty():
        single = single.unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_sha"]).select(*rows.columns))
    return single.toDF(*docs.columns)
