"""Reassembly and validation of records from broken multi-line CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.schema import RECORD_COLUMNS
from newsgraph.session import stored

# Fixed patterns of the raw format: a record starts with index, id and a word; a stamp is a date and a time.
RECORD_START = r"^\p{Nd}+,\p{Nd}{1,},[\p{L}\p{N}_]{1,}"
STAMP = r"\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d.\d+"
STAMP_PART = rf"^,?{STAMP}"

# Fixed limits of the title checks.
MIN_TITLE_LENGTH = 10
MAX_DIGIT_SHARE = 0.5
MIN_WORDS_PER_PHRASE = 3

REJECT_REASONS = {
    "R1": "fewer than 3 quoted parts",
    "R2": "not exactly 5 leading fields",
    "R3": "no part with a time stamp after the text",
    "R4": "not exactly 3 time stamps",
    "R5": "no title",
    "R6": "title is a bracketed list",
    "R7": "title too short",
    "R8": "title mostly digits",
    "R9": "title looks like a list of names",
}

POSITION = ["path", "block", "ordinal"]


def assemble_records(lines: DataFrame, drop_last: bool = False) -> DataFrame:
    """Join the lines from one record start up to the next into one record; earlier lines are ignored.

    ``lines`` comes from ``read_lines``. Returns ``path, block, ordinal, record`` where (block, ordinal) is the
    place of the record's first line. ``drop_last`` leaves out the last record of every file.

    The text is shuffled once, by file block, so no task handles more than one file split. Records that lie inside
    a block are complete there. Only the pieces at block edges, at most two per block, are shuffled again to their
    record.
    """
    block = W.partitionBy("path", "block")
    is_start = F.col("line").rlike(RECORD_START).cast("long")
    numbered = lines.select("path", "block", "line_id", "line", is_start.alias("is_start")).select(
        "path",
        "block",
        "line_id",
        "line",
        F.sum("is_start").over(block.orderBy("line_id").rowsBetween(W.unboundedPreceding, 0)).alias("ordinal"),
        F.sum("is_start").over(block).alias("starts"),
    )
    pieces = numbered.groupBy("path", "block", "starts", "ordinal").agg(
        _join_in_order("line_id", "line").alias("record")
    )
    # Stored once: inside pieces, edges and the counts per block all come from one cut of the files.
    pieces = stored(pieces, "record-pieces")
    inside = pieces.where("ordinal > 0 AND ordinal < starts").select(*POSITION, "record")
    edges = pieces.where("ordinal = 0 OR ordinal = starts")

    # The record that is still open when a block begins: the last one started in an earlier block of the file.
    # One small row per block and no text; even a file of 100 TB gives less than a million rows for its window.
    blocks = pieces.select("path", "block", "starts").distinct()
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("starts") > 0, F.struct("block", F.col("starts").alias("ordinal"))), True)
    open_records = blocks.select("path", "block", opened.over(earlier).alias("opened"))

    own = F.struct("block", "ordinal")
    stitched = (
        edges.join(open_records, ["path", "block"])
        .withColumn("owner", F.when(F.col("ordinal") > 0, own).otherwise(F.col("opened")))
        .where(F.col("owner").isNotNull())
        .groupBy("path", F.col("owner.block").alias("owner_block"), F.col("owner.ordinal").alias("owner_ordinal"))
        .agg(_join_in_order("block", "record").alias("record"))
        .select("path", F.col("owner_block").alias("block"), F.col("owner_ordinal").alias("ordinal"), "record")
    )
    if drop_last:
        last = stitched.groupBy("path").agg(F.max("block").alias("block"))
        stitched = stitched.join(last, ["path", "block"], "left_anti")
    return inside.unionByName(stitched)


def _join_in_order(order: str, text: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(ordered, lambda x: x[text]), "\n")


def with_parsed_fields(records: DataFrame) -> DataFrame:
    """Add the ten text fields of ``record`` and ``reject_reason`` (R1..R9, NULL when accepted).

    The parts of the record are columns of their own on the way, so that each is computed once per record.
    """
    has_stamp = F.transform("_parts", lambda part: part.rlike(STAMP_PART))
    at = F.array_position(has_stamp, True).cast("int") - 1  # index of the first stamp part, -1 when there is none
    stamps = F.filter(F.split(F.get("_parts", "_at"), ","), lambda piece: piece.rlike(STAMP))
    parts = (
        records.withColumn("_parts", F.split("record", '"'))
        .withColumns({"_head": F.split(F.get("_parts", F.lit(0)), ","), "_at": at})
        .withColumns({"_stamps": stamps, "title": F.get("_parts", F.col("_at") + 1)})
    )
    title = F.col("title")
    digits = F.length(F.regexp_replace(title, r"\P{Nd}", ""))
    blanks = F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit("")))
    commas = F.length(title) - F.length(F.replace(title, F.lit(","), F.lit("")))
    words_per_phrase = blanks / (commas + 1) + 1  # every phrase has one word more than it has blanks

    reason = (
        F.when(F.size("_parts") < 3, "R1")
        .when(F.size("_head") != 6, "R2")
        .when(F.col("_at") < 1, "R3")
        .when(F.size("_stamps") != 3, "R4")
        .when(title.isNull(), "R5")
        .when(title.rlike(r"^\[") & title.rlike(r"]$"), "R6")
        .when(F.length(title) <= MIN_TITLE_LENGTH, "R7")
        .when(digits / F.length(title) > MAX_DIGIT_SHARE, "R8")
        .when(words_per_phrase <= MIN_WORDS_PER_PHRASE, "R9")
    )
    body = F.array_join(F.slice("_parts", F.lit(2), F.greatest(F.col("_at") - 1, F.lit(0))), "")
    fields = {name: F.get("_head", F.lit(i)) for i, name in enumerate(RECORD_COLUMNS[:5])}
    fields["body"] = F.when(F.col("_at") >= 1, body)
    fields.update({name: F.get("_stamps", F.lit(i)) for i, name in enumerate(RECORD_COLUMNS[6:9])})
    return parts.withColumns({**fields, "reject_reason": reason}).drop("_parts", "_head", "_at", "_stamps")


def parse_all(records: DataFrame) -> DataFrame:
    """All records with ``reject_reason``: the fields of the accepted ones, the whole text of the rejected ones."""
    place = [c for c in POSITION if c in records.columns]
    parsed = with_parsed_fields(records)
    is_accepted = F.col("reject_reason").isNull()
    fields = [F.when(is_accepted, F.col(c)).alias(c) for c in RECORD_COLUMNS]
    return parsed.select(*place, *fields, F.when(~is_accepted, F.col("record")).alias("record"), "reject_reason")


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted records with their place, rejected records with ``reject_reason`` and the whole text)."""
    place = [c for c in POSITION if c in parsed.columns]
    accepted = parsed.where("reject_reason IS NULL").select(*place, *RECORD_COLUMNS)
    rejected = parsed.where("reject_reason IS NOT NULL").select(*place, "record", "reject_reason")
    return accepted, rejected


def parse_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_all`` and ``split_parsed`` in one step."""
    return split_parsed(parse_all(records))


def reject_counts(records: DataFrame) -> DataFrame:
    """Number of records per outcome; 'accepted' counts the parsed ones."""
    outcome = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return with_parsed_fields(records).groupBy(outcome).agg(F.count(F.lit(1)).alias("n_records"))


def dedupe_last_wins(df: DataFrame, key: str = "news_id", order: tuple[str, ...] = tuple(POSITION)) -> DataFrame:
    """The last record of every key, combined per task before the shuffle."""
    columns = df.columns
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    return df.groupBy(F.col(key).alias("_key")).agg(last).select(*[F.col(f"last.{c}").alias(c) for c in columns])


def drop_missing_keys(df: DataFrame, required: tuple[str, ...] = ("url", "domain", "label", "body")) -> DataFrame:
    """Records that have all of the fields the triples need."""
    return df.dropna(subset=list(required))
