from pyspark.sql import functions as F

from newsgraph.plans import jobs
from newsgraph.plans.queries import QUERIES
from newsgraph.plans.tables import CONFIG
from newsgraph.sources.config import MappingConfig
from newsgraph.sources.readers import file_manifest
from newsgraph.streaming.ingest import ingest_new_files
from tests.helpers import column, rows

SCHEMA = "text string, title string, site_url string, type string, file_name string, language string"


def drop_file(spark, folder, name, bodies):
    data = [(b, f"title {b}", f"u{b}", "fake", name, "en") for b in bodies]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_each_file_loads_once(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("to_add", "articles", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(run_ts, **options):
        ingest_new_files(spark, source, schema, CONFIG, table, checkpoint, run_ts, **options)
        return spark.read.parquet(table)

    drop_file(spark, source, "one", ["a", "b"])
    assert sorted(column(run("2024-01-01 00:00:00"), "body")) == ["a", "b"]
    assert sorted(column(run("2024-01-02 00:00:00"), "body")) == ["a", "b"]  # nothing new
    drop_file(spark, source, "two", ["c"])
    drop_file(spark, source, "three", ["d"])
    loaded = run("2024-01-03 00:00:00", max_files_per_batch=1)
    assert sorted(column(loaded, "body")) == ["a", "b", "c", "d"]
    stamps = dict(rows(loaded.select("body", loaded.etl_timestamp.cast("string"))))
    assert stamps == {"a": "2024-01-01 00:00:00", "b": "2024-01-01 00:00:00",
                      "c": "2024-01-03 00:00:00", "d": "2024-01-03 00:00:00"}
    assert loaded.select("load_id").distinct().count() == 3


def test_two_streams_fill_one_table(spark, tmp_path):
    table = str(tmp_path / "articles")
    schema = spark.createDataFrame([], SCHEMA).schema
    for name, texts in (("first", ["a", "b"]), ("second", ["c"])):
        drop_file(spark, str(tmp_path / name), "one", texts)
        ingest_new_files(
            spark, str(tmp_path / name), schema, CONFIG, table, str(tmp_path / f"c-{name}"), "2024-01-01 00:00:00"
        )
    assert sorted(r["body"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_source_is_one_file_or_a_folder_of_files(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    drop_file(spark, str(tmp_path / "in" / "a.parquet"), "one", ["a"])
    drop_file(spark, str(tmp_path / "in" / "a.parquet"), "two", ["b"])  # a folder of two files
    drop_file(spark, str(tmp_path / "loose"), "three", ["c"])
    (part,) = (tmp_path / "loose").glob("part-*")
    (tmp_path / "in" / "b.parquet").write_bytes(part.read_bytes())
    (tmp_path / "in" / "a.parquet" / "b.parquet").write_bytes(part.read_bytes())  # of that name, but not that file
    for name, texts in (("a", ["a", "b", "c"]), ("b", ["c"])):
        source, table = str(tmp_path / "in" / f"{name}.parquet"), str(tmp_path / f"table-{name}")
        for stamp in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):  # the second run finds nothing new
            ingest_new_files(spark, source, schema, CONFIG, table, str(tmp_path / f"c-{name}"), stamp)
            assert sorted(column(spark.read.parquet(table), "body")) == texts


def test_partition_folders_of_a_streamed_dataset_are_kept(spark, tmp_path):
    source, table = str(tmp_path / "in" / "a.parquet"), str(tmp_path / "articles")
    data = [(t, f"title {t}", f"u{t}", "fake", "one", lang) for t, lang in (("a", "de"), ("b", "fr"))]
    rows_in = spark.createDataFrame(data, SCHEMA)
    rows_in.write.partitionBy("language").parquet(source)
    ingest_new_files(spark, source, rows_in.schema, CONFIG, table, str(tmp_path / "c"), "2024-01-01 00:00:00")
    assert rows(spark.read.parquet(table).select("body", "language")) == [("a", "de"), ("b", "fr")]


def test_stream_queries_read_tables_that_are_folders(spark, tmp_path):
    """Tables of one file and the same tables as folders of several files give the same rows."""
    given = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{given}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("incremental_ingest", "ingest_two_streams"):
        assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, given))


def test_rejected_rows_are_kept(spark, tmp_path):
    source, table = str(tmp_path / "to_add"), str(tmp_path / "articles")
    drop_file(spark, source, "one", ["a", "b"])
    schema = spark.createDataFrame([], SCHEMA).schema
    without_title = lambda batch: batch.drop("title")
    ingest_new_files(
        spark, source, schema, CONFIG, table, str(tmp_path / "c"), "2024-01-01 00:00:00", prepare=without_title
    )
    assert spark.read.parquet(table).count() == 0
    rejected = spark.read.parquet(f"{table}_rejected")
    assert set(column(rejected, "reject_reason")) == {"missing mandatory column: title"}
    assert rejected.count() == 2


def test_file_manifest(spark, tmp_path):
    (tmp_path / "to_add").mkdir()
    for name in ("to_add/a.parquet", "to_add/b.json", "c.json"):
        (tmp_path / name).write_text("x")
    found = file_manifest(spark, str(tmp_path), r"/to_add/\w+")
    assert sorted(column(found, "file_name")) == ["a.parquet", "b.json"]
    assert column(file_manifest(spark, str(tmp_path), r"\.json$"), "n_bytes") == [1, 1]


def test_one_stream_takes_many_datasets(spark, tmp_path):
    source, table, configs = tmp_path / "in", str(tmp_path / "articles"), tmp_path / "configs"
    configs.mkdir()
    mandatory = {"body": "text", "url": "u", "label": "l", "title": "text", "file_name": "file_name"}
    for name, body in (("a", "text"), ("b", "content")):
        own = {**mandatory, "body": body, "title": body}
        (configs / f"{name}.parquet.yml").write_text(MappingConfig(own).to_text())

    def drop(name, schema, *data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(str(source / name))

    def run(stamp, **options):
        jobs.ingest_stream(spark, str(source), str(configs), table, str(tmp_path / "c"), stamp, **options)
        found = spark.read.parquet(table)
        return rows(found.select("file_name", "body", F.date_format("etl_timestamp", "d")))

    drop("a.parquet", "text string, u string, l string", ("a1", "u", "l"))
    drop("b.parquet/day=1", "content string, u string, l string", ("b1", "u", "l"))
    first = [("a.parquet", "a1", "1"), ("b.parquet", "b1", "1")]
    assert run("2024-01-01 00:00:00") == first
    assert run("2024-01-02 00:00:00") == first  # nothing new
    drop("a.parquet", "text string, u string, l string, more int", ("a2", "u", "l", 1))  # a column more
    drop("b.parquet/day=2", "content string, u string, l string", ("b2", "u", "l"))
    drop("c.parquet", "x int", (1,))
    late = [("a.parquet", "a1", "1"), ("a.parquet", "a2", "3"), ("b.parquet", "b1", "1"), ("b.parquet", "b2", "3")]
    assert run("2024-01-03 00:00:00", max_files_per_batch=1) == late
    assert rows(spark.read.parquet(f"{table}_rejected").select("reject_reason", "row")) == [
        ("no mapping config", '{"x":1,"file_name":"c.parquet"}')
    ]
