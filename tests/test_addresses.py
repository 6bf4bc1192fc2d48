import datetime
import io
import random
from array import array

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsgraph.operators.snapshot import append_articles, latest_articles, latest_snapshot, read_articles
from newsgraph.plans.jobs import snapshot_of
from newsgraph.schema import ARTICLE_COLUMNS, ARTICLE_SCHEMA
from newsgraph.sources import addresses
from newsgraph.sources.addresses import addressed, fetch_rows
from tests.helpers import rows


def articles(spark, n, day, **more):
    """Every key twice, ``n`` rows; keys that are multiples of 7 are NULL."""
    key = (F.col("id") / 2).cast("long")
    columns = {c: F.lit(None).cast("string") for c in ARTICLE_COLUMNS} | {
        "etl_timestamp": F.lit(datetime.datetime(2024, 1, day)).cast("timestamp"),
        "article_id": F.when(key % 7 != 0, key.cast("string")),
        "url": F.lit("u"),
        "label": (F.col("id") % 2).cast("string"),
        "body": F.concat(F.lit("body é "), F.col("id"), F.lit(f" of {day}")),
    }
    return spark.range(n).select(*[(columns | more)[c].alias(c) for c in ARTICLE_COLUMNS])


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/a table %41"
    append_articles(articles(spark, 4000, 1).repartition(3), path, "one")
    late = articles(spark, 900, 2).drop("country_of_origin").coalesce(1)  # a file of an older layout
    late.write.option("parquet.block.size", 4096).parquet(f"{path}/load_id=two")
    append_articles(articles(spark, 50, 3, body=F.lit(None).cast("string")), path, "three")
    return path


def test_late_fetch_gives_the_latest_snapshot(spark, table):
    expected = latest_snapshot(read_articles(spark, table))
    got = snapshot_of(spark, table, late=True)
    assert got.schema.fieldNames() == ARTICLE_COLUMNS
    assert rows(got.fillna("-")) == rows(expected.fillna("-")) and got.count() > 3000


def test_unique_rows_by_tie_columns_and_by_content(spark, table):
    expected = latest_snapshot(read_articles(spark, table), unique=True, tiebreak=("label",))
    got = latest_articles(spark, table, unique=True, tiebreak=("label",))
    assert rows(got.fillna("-")) == rows(expected.fillna("-"))
    free = latest_articles(spark, table, unique=True)
    assert free.count() == expected.count() == free.select("article_id", "url").distinct().count()
    assert rows(free.fillna("-")) == rows(latest_articles(spark, table, unique=True).fillna("-"))


def test_bodies_are_in_no_shuffle(spark, table):
    plan = latest_articles(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # addresses are stored before; only they are dealt
    scan = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert scan and all("_row" in line and "body" not in line.split("MapInArrow")[-1] for line in scan)


def test_rows_by_address_across_row_groups(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    table = pa.table({"id": list(range(5000)), "pad": ["x" * 50] * 5000})
    pq.write_table(table, path, row_group_size=700)
    found = addressed(spark.read.schema("id long, pad string, more int").parquet(path)).where("id % 699 = 0 OR id = 4999")
    got = fetch_rows(found.unionByName(found.where("id = 0")), found.drop("_file", "_row").schema)
    wanted = sorted([0, *range(0, 5000, 699), 4999])
    assert sorted(r.id for r in got.collect()) == wanted
    assert got.where("more IS NULL AND length(pad) = 50").count() == len(wanted)
    assert fetch_rows(found.limit(0), ARTICLE_SCHEMA).count() == 0


class Watched(io.FileIO):
    largest = 0

    def read(self, size=-1):
        got = super().read(size)
        self.largest = max(self.largest, len(got))
        return got


@pytest.mark.parametrize("long, n", [(4_000, 6_000), (400_000, 60)])
def test_a_fetch_holds_no_row_group(tmp_path, long, n):
    """One row group of 24 MB: neither its chunks nor its rows are in memory as a whole, and rows come as they are asked for."""
    draw = random.Random(n)
    bodies = [draw.randbytes(long // 2).hex() for _ in range(n)]
    path = str(tmp_path / "wide.parquet")
    schema = pa.schema([("id", pa.int64()), ("body", pa.string()), ("absent", pa.string())])
    data = pa.table({"id": range(n), "body": bodies})
    pq.write_table(data, path, row_group_size=n, data_page_size=1 << 18, write_batch_size=1, use_dictionary=False)
    asked = [i for i in range(n) if i % 5 != 3 and i < n - 7]
    with Watched(path) as file:
        found = list(addresses._wanted(addresses._streamed(pa.PythonFile(file, "r")), array("q", asked), schema))
        assert file.largest < 2 << 20  # a chunk is 24 MB
    assert [i for b in found for i in b.column("id").to_pylist()] == asked
    assert [t for b in found for t in b.column("body").to_pylist()] == [bodies[i] for i in asked]
    assert max(b.num_rows for b in found) <= addresses.BATCH_ROWS
    assert max(sum(map(len, b.column("body").to_pylist())) for b in found) <= addresses.BATCH_BYTES
