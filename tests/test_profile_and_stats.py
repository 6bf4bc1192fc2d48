import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from newsgraph.operators import profile, sinks, stats
from newsgraph.sources.readers import read_csv
from tests.helpers import rows
from tests.test_functions import LABEL_COUNTS

# Golden numbers: stage 1 times (seconds) of the five runs with 1,250 articles, and their saved summary.
TIMES = [
    (1250, "Stage 1", 45.64, 108.75, 324, 475),
    (1250, "Stage 1", 34.59, 111.45, 352, 456),
    (1250, "Stage 1", 35.49, 107.28, 356, 458),
]


def test_flag_matches_a_loop_over_sorted_rows(spark):
    rng = random.Random(1)
    data = [(f"d{rng.randint(0, 5)}", f"l{i}", rng.randint(1, 4)) for i in range(40)] + [(None, "x", 2), (None, "y", 3)]
    df = spark.createDataFrame(data, "domain string, label string, n long")
    seen, expected = set(), []
    for domain, label, n in sorted(data, key=lambda r: (-r[2], r[1])):
        expected.append((domain, label, n, domain in seen))
        seen.add(domain)
    assert rows(profile.domain_multi_label(df)) == sorted(expected, key=str)


def test_label_reports_match_the_saved_ones(spark):
    data = [(f"d{i}", label, n) for i, (label, n) in enumerate(LABEL_COUNTS.items())] + [(None, "rumor", 0)]
    df = spark.createDataFrame(data, "domain string, label string, n long")
    summary = profile.label_summary(df, "n").collect()
    assert [r["label"] for r in summary] == list(LABEL_COUNTS)
    assert summary[0]["url_count_pct"] == pytest.approx(35.43441226575809)
    domains = {r["label"]: r for r in profile.domains_per_label(df).collect()}
    assert domains["rumor"]["domain_count"] == 1  # the missing domain is not counted
    assert sum(r["domain_count_pct"] for r in domains.values()) == pytest.approx(100)


def test_reuse_reports(spark):
    data = [("b1", "l", "u1", "d"), ("b1", "l", "u1", "d"), ("b1", "l", "u2", "d"), ("b2", "m", "u3", "d"),
            ("b2", "l", "u3", "d")]
    df = spark.createDataFrame(data, "body_hash string, label string, url_hash string, domain_hash string")
    assert [tuple(r) for r in profile.reused_bodies(df).collect()] == [("b1", "l", 2), ("b2", "l", 1), ("b2", "m", 1)]
    assert profile.reused_bodies(df, distinct=False).first()["url_count"] == 3
    assert [tuple(r) for r in profile.cross_domain_bodies(df, top=1).collect()] == [("b2", "d", 2)]
    assert rows(profile.duplicate_keys(df, "url_hash")) == [("u1", 2), ("u3", 2)]


def test_reconcile(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("d",)], "k string")
    found = profile.reconcile(left, right, "k")
    assert rows(found) == [
        ("a", 2, 1, "different"), ("b", 1, 1, "equal"), ("c", 1, 0, "left only"), ("d", 0, 1, "right only"),
    ]
    assert dict((r[0], r[1:]) for r in rows(profile.reconcile_summary(found)))["equal"] == (1, 1, 1)


def test_describe_agrees_with_pandas(spark):
    rng = random.Random(5)
    frame = pd.DataFrame(
        {
            "text": [rng.choice(["x", "y", "zz", None]) for _ in range(101)],
            "number": [rng.gauss(0, 10) for _ in range(101)],
            "count": [rng.randint(0, 5) for _ in range(101)],
        }
    )
    frame.loc[3, "number"] = np.nan
    data = [(r.text, None if np.isnan(r.number) else r.number, int(r.count_)) for r in
            frame.rename(columns={"count": "count_"}).itertuples()]
    df = spark.createDataFrame(data, "text string, number double, count int")
    found = {r["column"]: r for r in profile.describe_columns(df).collect()}
    want = frame.describe(include="all")
    for name in ("number", "count"):
        ours_names = ("mean", "std", "min", "q25", "q50", "q75", "max")
        for ours, theirs in zip(ours_names, ("mean", "std", "min", "25%", "50%", "75%", "max")):
            assert found[name][ours] == pytest.approx(want[name][theirs])
        assert found[name]["count"] == want[name]["count"]
    assert found["text"]["count"] == want["text"]["count"]
    assert found["text"]["unique"] == want["text"]["unique"]
    assert found["text"]["freq"] == want["text"]["freq"]
    assert (frame["text"] == found["text"]["top"]).sum() == found["text"]["freq"]


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    st.lists(st.integers(0, 3), min_size=1, max_size=60),
)
def test_quantiles_agree_with_numpy(spark, floats, integers):
    data = [("a", float(v)) for v in floats] + [("b", float(v)) for v in integers] + [("c", None), (None, 1.0)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}
    found = {r["k"]: r for r in stats.exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(found) == {"a", "b", None}
    for key, values in (("a", floats), ("b", integers), (None, [1.0])):
        for name, q in wanted.items():
            assert found[key][name] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


def test_quantiles_of_a_large_group_with_a_hot_value(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) for _ in range(20_000)] + [0.25] * 10_000  # a third of the rows share one value
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(8)
    wanted = {f"q{p}": p / 100 for p in (1, 25, 50, 60, 75, 99)}
    found = stats.exact_quantiles(df, ["k"], "v", wanted).first()
    for name, q in wanted.items():
        assert found[name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_melt_summary_and_line(spark, tmp_path):
    wide = spark.createDataFrame(TIMES, "Size int, Stage string, `1a` double, `1b` double, `1c` int, `1d` int")
    sinks.write_csv(wide, str(tmp_path / "times"))
    read = read_csv(spark, str(tmp_path / "times"))
    assert read.dtypes[0] == ("Size", "int") and read.dtypes[2] == ("1a", "double")
    long = stats.melt(read, ["Size", "Stage"])
    assert long.count() == 12
    found = {r["variable"]: r for r in stats.summarize(long, ["Size", "Stage", "variable"]).collect()}
    assert found["1a"]["median"] == 35.49
    assert found["1a"]["mean"] == pytest.approx(np.mean([45.64, 34.59, 35.49]))
    assert found["1c"]["std_dev"] == pytest.approx(np.std([324, 352, 356], ddof=1))


def test_csv_with_byte_order_mark_quotes_and_line_breaks(spark, tmp_path):
    content = '\ufeffSize,Stage,note\n1250,Stage 1,"two\nlines, ""quoted"""\n2500,Stage 1,\n'
    (tmp_path / "bom.csv").write_text(content, encoding="utf-8")
    read = read_csv(spark, str(tmp_path / "bom.csv"), multi_line=True)
    assert read.dtypes == [("Size", "int"), ("Stage", "string"), ("note", "string")]
    assert rows(read) == [(1250, "Stage 1", 'two\nlines, "quoted"'), (2500, "Stage 1", None)]


def test_ols_agrees_with_numpy(spark):
    rng = random.Random(2)
    points = [(c, x, 3 * x + 7 + rng.gauss(0, 1)) for c in "ab" for x in range(20)]
    df = spark.createDataFrame(points, "config string, x long, y double")
    found = {r["config"]: r for r in stats.ols(df, ["config"], "x", "y").collect()}
    for c in "ab":
        xs, ys = zip(*[(x, y) for k, x, y in points if k == c])
        slope, intercept = np.polyfit(xs, ys, 1)
        assert found[c]["slope"] == pytest.approx(slope)
        assert found[c]["intercept"] == pytest.approx(intercept)
        assert found[c]["r2"] == pytest.approx(np.corrcoef(xs, ys)[0, 1] ** 2)
        assert found[c]["n"] == 20


def test_every_column_type_is_described(spark):
    df = spark.sql("SELECT 1 AS id, true AS flag, timestamp'2024-01-01 00:00:00' AS ts, array(1, 2) AS xs, X'ff' AS raw")
    found = {r["column"]: r for r in profile.describe_columns(df).collect()}
    assert set(found) == {"id", "flag", "ts", "xs", "raw"}
    assert found["flag"]["top"] == "true" and found["ts"]["top"] == "2024-01-01 00:00:00"


@pytest.mark.parametrize(
    "values",
    [
        [3.5] * 40,
        [-1e300, -2.0, -0.0, 0.0, 5e-324, 1.0, 1e300],
        [1 + i * 2.0**-52 for i in range(1000)],  # neighbouring doubles
        [float("-inf"), -1.0, 2.0, float("inf"), float("inf")],
        [10.0**i for i in range(-300, 300)],
    ],
)
def test_quantiles_of_unusual_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.25, 0.5, 1.0):
        place = q * (len(values) - 1)
        low, high = sorted(values)[math.floor(place)], sorted(values)[math.ceil(place)]
        expected = low if low == high else low + (high - low) * (place - math.floor(place))
        assert stats.exact_quantiles(df, [], "v", {"q": q}).first()["q"] == expected


def test_quantiles_with_null_keys_not_a_number_and_no_values(spark):
    data = [(None, 1.0), (None, 3.0), ("a", 1.0), ("a", float("nan")), ("a", 2.0), ("b", None)]
    df = spark.createDataFrame(data, "value string, v double")
    found = {r["value"]: r for r in stats.exact_quantiles(df, ["value"], "v", {"m": 0.5, "top": 1.0}).collect()}
    assert set(found) == {None, "a"}
    assert (found[None]["m"], found[None]["top"], found["a"]["m"]) == (2.0, 3.0, 2.0)
    assert math.isnan(found["a"]["top"])


def test_order_bits_keep_the_order(spark):
    draw = np.random.default_rng(3)
    values = draw.integers(0, 1 << 63, 3000, np.uint64).view(np.float64).tolist()  # any bit pattern
    values += (2.0 ** draw.integers(-1074, 1023, 300)).tolist() + [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    values += [np.nextafter(v, d) for v in (1.0, 2.0, 0.1, 2.0**-1022, 1e300) for d in (0, np.inf)] + [0.0, -0.0, np.inf]
    values = [v for v in values + [-v for v in values] if v == v]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", stats.order_bits(F.col("v")).alias("b"))
    found = {r["v"] + 0.0: r["b"] for r in df.collect()}
    order = sorted(found)
    bits = [found[v] for v in order]
    assert bits == sorted(bits) and len(set(bits)) == len(order)
    positive = np.array([v for v in order if v > 0])
    assert [found[v] for v in positive.tolist()] == positive.view(np.int64).tolist()
    assert df.sparkSession.range(1).select(stats.order_bits(F.lit(float("nan")))).first()[0] > max(bits)


def test_quantiles_of_values_in_one_narrow_bin_with_an_outlier(spark):
    values = [1 + k * 2.0**-52 for k in range(5000)] + [1e308, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    found = stats.exact_quantiles(df, [], "v", wanted).first()
    order = sorted(values)
    for name, q in wanted.items():
        rank = q * (len(order) - 1)
        low, high = order[math.floor(rank)], order[math.ceil(rank)]
        assert low <= found[name] <= high
