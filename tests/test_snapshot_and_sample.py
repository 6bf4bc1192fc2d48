import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsgraph.operators.sampling import number_in_place, sample_rows
from newsgraph.operators.snapshot import latest_snapshot, lookup
from tests.helpers import rows

DATA = [
    ("a", "u", 1, "old"),
    ("a", "u", 2, "new"),
    ("a", "u", 2, "tie"),
    ("a", "v", 1, "other url"),
    ("b", "u", 3, "only"),
    (None, "u", 9, "no id"),
    ("c", None, 9, "no url"),
]
SCHEMA = "article_id string, url string, etl_timestamp long, label string"


def test_ties_survive_and_null_keys_drop(spark):
    latest = latest_snapshot(spark.createDataFrame(DATA, SCHEMA))
    assert latest.columns == ["article_id", "url", "etl_timestamp", "label"]
    assert rows(latest.select("label")) == [("new",), ("only",), ("other url",), ("tie",)]


def test_unique_keeps_one_row_per_key(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    latest = latest_snapshot(df, unique=True, tiebreak=("label",))
    assert rows(latest.select("label")) == [("new",), ("only",), ("other url",)]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # hot keys are cut before the shuffle


def test_snapshot_with_a_key_that_holds_a_third_of_the_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("article_id"),
        F.lit("u").alias("url"),
        (F.col("id") % 7).alias("etl_timestamp"),
        F.col("id").cast("string").alias("label"),
    )
    expected = Counter()
    for i in range(3000):
        if i % 3 != 0 or i % 7 == 6:
            expected["hot" if i % 3 == 0 else "cold"] += 1
    found = Counter("hot" if r["article_id"] == "hot" else "cold" for r in latest_snapshot(df).collect())
    assert found == expected


def test_lookup(spark):
    assert lookup(spark.createDataFrame(DATA, SCHEMA), "article_id", "b").count() == 1


@pytest.mark.parametrize("n", [1, 10, 499, 1000, 5000])
def test_sample_is_exact_and_repeatable(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "key")
    found = [r["key"] for r in sample_rows(df, "key", n, seed=7).collect()]
    order = sorted(range(1000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert sorted(found) == sorted(order[:n])
    assert len(set(found)) == min(n, 1000)


@pytest.mark.parametrize("n", [0, 1, 150, 299, 300, 301])
def test_sample_of_one_key(spark, n):
    df = spark.range(300).select(F.lit("k").alias("key"), "id").repartition(7)
    found = sample_rows(df, "key", n)
    assert len({r["id"] for r in found.collect()}) == min(n, 300)
    assert sample_rows(df.withColumn("key", F.lit(None).cast("string")), "key", n).count() == min(n, 300)


def test_ties_are_numbered_without_a_gathering_window(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("key"), "id").repartition(5)
    numbered = number_in_place(df, "number")
    assert sorted(r["number"] for r in numbered.collect()) == list(range(100))
    plan = sample_rows(df, "key", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(_part" in plan
