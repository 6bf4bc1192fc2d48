"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import by_position, ranked, word_count
from newsgraph.session import stored

WEIGHTS = (5, 2, 1)  # production parameters: weights in source order, repeating
SHARE = 1.5  # the mix takes this multiple of all tokens
MOST = 2.0  # no source is repeated more often
SEED = "mix-1"


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size, target, rate`` from rows of (source, size).

    The targets share ``share`` times the whole size by weight. A source that would need more than ``most`` times
    its size stops there and the excess goes to the others by weight, until none is above. The common level
    (tokens per unit of weight) is found by repeated totals over one row per source, which never leave the
    executors; it only rises, so the set of stopped sources grows to its fixed point.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.col("position") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position + 1).cast("int"))
    rows = stored(
        ranked(per_source, F.col("source").asc_nulls_last())
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(most))
        .drop("position"),
        "mix_sources",
    )
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = -1.0
    while True:
        stopped = F.col("most") < F.lit(level) * F.col("weight")
        at_most, open_weight = rows.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0)),
        ).first()
        raised = (total - at_most) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _with_rates(sized: DataFrame, source_col: str, targets: DataFrame) -> DataFrame:
    # The targets are a written table: Spark broadcasts it only when its files are below the session's threshold.
    rates = targets.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    joined = sized.join(rates, sized[source_col].eqNullSafe(rates["_source"])).drop("_source")
    whole = F.floor("rate")
    extra = (F.col("_draw") < F.col("rate") - whole).cast("long")
    return joined.withColumn("_copies", whole.cast("long") + extra)


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    Defined results: a NULL text has size 0; NULL is a source of its own, ordered last; a source without words has
    rate 0. Rows with one id get one draw, so repeated rows are repeated alike. Empty input: no rows.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        draw(F.col(id_col), seed).alias("_draw"),
    )
    sizes = stored(sizes, "mix_sizes")  # words are counted once
    targets = stored(source_targets(sizes, weights, share, most), "mix_targets")
    plan = _with_rates(sizes, "source", targets).withColumnRenamed("_copies", "copies")
    plan = plan.withColumn("taken", F.col("size") * F.col("copies"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` floor(rate) times plus its drawn copy, all columns kept."""
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    targets = stored(source_targets(totals, weights, share, most), "mix_targets")
    rows = by_position(docs)
    own_id, own_source = (rows.columns[docs.columns.index(c)] for c in (id_col, source_col))
    copies = _with_rates(rows.withColumn("_draw", draw(F.col(own_id), seed)), own_source, targets)
    copies = copies.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return copies.select(*rows.columns).toDF(*docs.columns)
