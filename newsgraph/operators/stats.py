"""Reshaping and statistics of measured values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.session import stored

_BITS = 64
_DIGIT = 16  # bits by which each step narrows a rank


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None) -> DataFrame:
    """Wide to long: one row per id and measured column."""
    return df.unpivot(ids, values, "variable", "value")


def order_bits(value: Column) -> Column:
    """A double as a 64-bit integer of the same order, different for different values; NaN is the largest.

    Powers of two are exact, so exponent and fraction are taken out without rounding; the estimate of the exponent by
    its logarithm is corrected where it is one off.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
    exponent = exponent.when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).cast("long")
    normal = (exponent.cast("long") + 1023) * (1 << 52) + fraction
    small = (size * 2.0**537 * 2.0**537).cast("long")  # below the smallest normal number the steps are equal
    infinite = F.lit(2047 << 52)
    bits = F.when(size == float("inf"), infinite).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -bits).otherwise(bits)


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which NULL keys meet; the columns of ``on`` are kept once."""
    renamed = right.withColumnsRenamed({c: f"_right{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_right{c}")) for c in on]
    return left.join(renamed, condition).drop(*[f"_right{c}" for c in on])


def _ranked(counts: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Add ``upto``, the number of values of the group up to and with this row."""
    rows = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(rows))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) per key, one column per requested quantile.

    Radix selection: values are read as integers of the same order, and every wanted rank is narrowed 16 bits a step,
    by counts of the values with the prefix found so far. A step is one aggregation that is combined per task and has
    65,536 rows at most per key and rank, however the values are spread; after four steps at most, one value is left.
    A rank whose prefix holds one value only is settled at once. NULLs are left out, NaN is the largest value, a key
    without values has no row.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    known = (
        df.where(F.col(value).isNotNull())
        .select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("value"))
        .withColumn("bits", order_bits(F.col("value")))
    )
    rank = {name: F.lit(float(q)) * (F.col("total") - 1) for name, q in quantiles.items()}
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("quantile"),
                F.lit(side).alias("side"),
                (r - F.floor(r)).alias("part"),
                (F.floor(r) if side == "floor" else F.ceil(r)).alias("place"),
            )
            for name, r in rank.items()
            for side in ("floor", "ceil")
        ]
    )
    target = [*names, "quantile", "side", "part"]
    settled, ranks = [], None
    for shift in range(_BITS - _DIGIT, -1, -_DIGIT):
        prefix = F.shiftright("bits", shift).alias("prefix")
        extent = (F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        if ranks is None:
            counts = _ranked(known.groupBy(*names, prefix).agg(*extent), names, "prefix")
            counts = counts.withColumn("total", F.sum("n").over(W.partitionBy(*names)))
            met = counts.select(*names, "prefix", "n", "upto", "low", "high", F.inline(wanted))
        else:
            # The stored ranks have two rows per key and quantile, so Spark sees their size and the values stay in place.
            known_so_far = known.withColumn("before", F.shiftright("bits", shift + _DIGIT))
            near = _same(known_so_far, ranks.select(*names, "before").distinct(), [*names, "before"])
            counts = near.groupBy(*names, "before", prefix).agg(*extent)
            met = _same(ranks, _ranked(counts, [*names, "before"], "prefix"), [*names, "before"])
        met = met.where("place < upto AND place >= upto - n")
        place = F.expr("place - (upto - n)").alias("place")
        found = stored(met.select(*target, F.col("prefix").alias("before"), place, "low", "high"), "ranks")
        settled.append(found.where("low = high").select(*target, F.col("low").alias("value")))
        ranks = found.where("low <> high").drop("low", "high")
        if ranks.isEmpty():
            break

    at_floor = F.max(F.when(F.col("side") == "floor", F.col("value")))
    at_ceiling = F.max(F.when(F.col("side") == "ceil", F.col("value")))
    between = at_floor + (at_ceiling - at_floor) * F.max("part")
    picked = reduce(DataFrame.union, settled).groupBy(*names, "quantile").agg(
        F.when(at_floor == at_ceiling, at_floor).otherwise(between).alias("result")
    )
    return picked.groupBy(*[F.col(n).alias(c) for c, n in zip(keys, names, strict=True)]).agg(
        *[F.max(F.when(F.col("quantile") == name, F.col("result"))).alias(name) for name in quantiles]
    )


def summarize(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, median, mean and sample standard deviation per key."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_dev")
    )
    return moments.join(exact_quantiles(df, keys, value, {"median": 0.5}), keys, "left")


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per key: slope, intercept, R squared and number of points."""
    y_col, x_col = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(y_col, x_col).alias("slope"),
        F.regr_intercept(y_col, x_col).alias("intercept"),
        F.regr_r2(y_col, x_col).alias("r2"),
        F.regr_count(y_col, x_col).alias("n"),
    )
