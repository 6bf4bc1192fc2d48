import pytest
from pyspark.sql import functions as F

from newsgraph.operators.redistribute import redistribute
from newsgraph.operators.sinks import write_documents
from newsgraph.plans import queries
from newsgraph.session import stored
from newsgraph.sources.documents import document_offsets, fetch_documents, write_document_index
from tests.helpers import column, rows

LONG = "\n".join(f"<s{i}> <p> \"x\r é😀\" ." for i in range(3000))


@pytest.fixture(scope="module")
def documents(spark):
    data = [(f"n{i}", f"<s> <p> \"{i} é\" .\n_:b{i} <p> <o> ." * (i % 5 + 1)) for i in range(200)]
    return spark.createDataFrame([*data, ("long", LONG), ("empty", "")], "name string, document string").repartition(3)


def test_documents_are_found_by_name(spark, documents, tmp_path):
    path, index = str(tmp_path / "a b+c" / "text"), str(tmp_path / "index")
    write_documents(documents, path)
    write_document_index(spark, path, index)
    found = fetch_documents(spark.read.parquet(index), documents)
    assert rows(found) == rows(documents)
    few = spark.createDataFrame([("long",), ("n7",), ("n7",), ("absent",)], "name string")
    assert rows(fetch_documents(spark.read.parquet(index), few)) == rows(documents.where("name IN ('long', 'n7')"))
    assert fetch_documents(spark.read.parquet(index), few.limit(0)).count() == 0


def test_offsets_do_not_depend_on_the_blocks(spark, documents, tmp_path):
    path = str(tmp_path / "text")
    write_documents(documents.coalesce(1), path)
    whole = rows(document_offsets(spark, path))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # blocks end inside lines
    try:
        assert rows(document_offsets(spark, path)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert len(whole) == 202 and sum(r[3] for r in whole) == sum(f.stat().st_size for f in (tmp_path / "text").glob("part-*"))


def by_reading(folder):
    """The index by reading the files as a whole."""
    found = []
    for file in folder.glob("part-*"):
        data, place = file.read_bytes(), 0
        starts = []
        for line in data.split(b"\n")[:-1]:
            if line.startswith(b"# "):
                starts.append((place, line[2:].decode()))
            place += len(line) + 1
        ends = [p for p, _ in starts[1:]] + [len(data)]
        found += [(name, file.name, p, end - p) for (p, name), end in zip(starts, ends)]
    return sorted(found, key=str)


@pytest.mark.parametrize("block", ["61", "64", "509"])
def test_offsets_wherever_blocks_end(spark, tmp_path, block):
    data = [(f"n{i}", ["", "#x\n #\n", "<é> \r# .", "l\n" * (i % 11)][i % 4]) for i in range(70)]
    write_documents(spark.createDataFrame(data, "name string, document string").coalesce(2), str(tmp_path / "text"))
    (tmp_path / "text" / "part-x").write_bytes(b"no head\n#no\n# first\n# # second\nl\n")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = rows(document_offsets(spark, str(tmp_path / "text")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert sorted([(n, f.rsplit("/", 1)[1], p, length) for n, f, p, length in found], key=str) == by_reading(tmp_path / "text")
    assert len(found) == 72


def test_named_documents_are_made_without_texts(spark, monkeypatch):
    """The articles that the names are taken of are stored without their bodies, which no snapshot has to shuffle."""
    kept = {}
    monkeypatch.setattr(queries, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    found = queries.documents_by_name(spark, "/root/testdata/sf0.001")
    (articles,) = kept.values()
    assert "body_hash" in articles.columns and not {"body", "title"} & set(articles.columns)
    assert rows(found) == rows(queries.turtle_documents(spark, "/root/testdata/sf0.001"))


def weights(df):
    return column(df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("w").alias("w")), "w")


def test_partitions_have_even_weight(spark):
    # A third of the weight lies in the first of many rows' partition, one row is as heavy as a share.
    df = spark.range(0, 3000, 1, 7).select("id", F.when(F.col("id") == 11, 5000).when(F.col("id") < 400, 40).otherwise(10).alias("w"))
    even = redistribute(df, F.col("w"), 12)
    assert rows(even) == rows(df)
    found = weights(even)
    assert len(found) <= 12 and max(found) <= 2 * sum(found) / len(found)
    assert even.rdd.getNumPartitions() <= 13


def test_weights_that_are_missing(spark):
    df = spark.createDataFrame([(1, None), (2, -5), (3, 0), (4, 2)], "id int, w long")
    assert rows(redistribute(df, F.col("w"), 3)) == rows(df)
    assert rows(redistribute(df.where("id < 4"), F.col("w"), 3)) == rows(df.where("id < 4"))
    assert redistribute(df.limit(0), F.col("w"), 3).count() == 0
