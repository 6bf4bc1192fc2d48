import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsgraph.operators import ingest
from newsgraph.plans import jobs
from newsgraph.schema import ARTICLE_COLUMNS
from newsgraph.sources import catalogue
from newsgraph.sources import config as mapping
from newsgraph.sources.config import MappingConfig
from tests.helpers import column, rows

YAML = """
source: https://example.org/data
mandatory_columns:
  body: {column_name: text}
  file_name: {column_name: file_name}
  label: {column_name: type}
  title: {column_name: title}
  url: {column_name: site_url}
supplementary_columns:
  author: {column_name: author}
  publication_date: {column_name: published}
  detailed_news_label: {column_name: ''}
custom_columns:
- likes
- absent_one
"""
SCHEMA = "text string, title string, type string, site_url string, file_name string, published string, likes long"
RUN = "2024-03-01 12:00:00"


def sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


@pytest.fixture(scope="module")
def config():
    pytest.importorskip("yaml")
    return MappingConfig.from_text(YAML)


@pytest.fixture(scope="module")
def source(spark):
    data = [
        ("body é", "title", "fake", "u1", "a.parquet", "2021-11-06", 3),
        ("", None, "null", "", "a.parquet", "not a date", None),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_null_layers(spark, config, source):
    accepted, rejected = ingest.map_articles(source, config, RUN)
    assert accepted.columns == ARTICLE_COLUMNS
    assert rejected.count() == 0
    full, empty = sorted(accepted.collect(), key=lambda r: r["body"])
    assert str(full["etl_timestamp"]) == RUN
    assert full["author"] == "null"  # absent supplementary column
    assert json.loads(full["custom_columns"]) == {"likes": 3, "absent_one": "null"}
    assert (empty["body"], empty["title"], empty["url"], empty["label"]) == ("null",) * 4
    assert json.loads(empty["custom_columns"]) == {"likes": None, "absent_one": "null"}
    assert empty["body_hash"] == empty["url_hash"] == empty["author_hash"] == sha("null")
    assert full["article_id"] == sha("title") + sha("body é")
    dates = {r["publication_ts"] is None for r in ingest.with_parsed_dates(accepted).collect()}
    assert dates == {True, False}


def test_missing_mandatory_column_quarantines_each_row_once(config, source):
    accepted, rejected = ingest.map_articles(source.drop("type"), config, RUN)
    assert accepted.count() == 0
    assert set(column(rejected, "reject_reason")) == {"missing mandatory column: label"}
    assert json.loads(ingest.quarantine(rejected).first()["row"])["file_name"] == "a.parquet"
    assert rejected.count() == source.count()


def test_non_text_values_are_cast(spark, config):
    df = spark.createDataFrame([("b", 7, 1, "u", "f", None, 1)], SCHEMA.replace("title string", "title long"))
    df = df.withColumn("type", F.lit(1))
    row = ingest.map_articles(df, config, RUN)[0].first()
    assert (row["title"], row["label"], row["title_hash"]) == ("7", "1", sha("7"))


def test_mixed_datasets(config, source):
    other = MappingConfig({**config.mandatory, "title": "text"}, {}, ())
    both = source.unionByName(source.withColumn("file_name", F.lit("b"))).unionByName(
        source.withColumn("file_name", F.lit("c"))
    )
    accepted, rejected = ingest.map_mixed_articles(both, {"a.parquet": config, "b": other}, RUN)
    found = {(r["file_name"], r["body"]): r for r in accepted.collect()}
    assert len(found) == 4
    assert found["a.parquet", "body é"]["title"] == "title"
    assert found["b", "body é"]["title"] == "body é"
    assert found["b", "body é"]["custom_columns"] == "{}"
    assert set(column(rejected, "reject_reason")) == {"no mapping config"}
    assert accepted.count() + rejected.count() == both.count()


def test_mixed_equals_single_when_there_is_one_config(config, source):
    single, _ = ingest.map_articles(source, config, RUN)
    mixed, _ = ingest.map_mixed_articles(source, {"a.parquet": config}, RUN)
    assert sorted(single.collect(), key=str) == sorted(mixed.collect(), key=str)


def test_config_checks():
    columns = {c: {"column_name": c} for c in ("body", "url", "label", "title", "file_name")}
    assert MappingConfig.from_dict({"mandatory_columns": columns, "custom_columns": None}).custom == ()
    with pytest.raises(ValueError):
        MappingConfig.from_dict({"mandatory_columns": {"body": {"column_name": "text"}}})
    with pytest.raises(ValueError):
        MappingConfig.from_dict({"mandatory_columns": columns, "extra": 1})
    with pytest.raises(ValueError):
        MappingConfig.from_dict({"mandatory_columns": columns, "supplementary_columns": {"colour": {}}})


def test_ingest_job_with_config_folder(spark, config, source, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "a.parquet.yml").write_text(YAML)
    assert mapping.load_configs(spark, str(tmp_path / "configs")) == {"a.parquet": config}
    source.write.parquet(str(tmp_path / "to_add"))
    table = str(tmp_path / "articles")
    for run in (RUN, RUN, "2024-04-01 00:00:00"):  # a repeated load replaces itself
        jobs.ingest_dataset(spark, str(tmp_path / "to_add"), str(tmp_path / "configs"), table, run)
    assert spark.read.parquet(table).count() == 4
    latest = jobs.snapshot_of(spark, table)
    assert {str(t) for t in column(latest, "etl_timestamp")} == {"2024-04-01 00:00:00"}
    with pytest.raises(FileNotFoundError):
        mapping.load_configs(spark, str(tmp_path / "to_add"))


def test_ingest_job_keeps_every_dataset_and_source(spark, tmp_path):
    configs, folder, other, table = (str(tmp_path / n) for n in ("configs", "in", "other", "articles"))
    (tmp_path / "configs").mkdir()
    text = "source: x\nmandatory_columns:\n" + "".join(
        f"  {c}: {{{{column_name: {{{c}}}}}}}\n" for c in ("body", "url", "label", "title")
    ) + "  file_name: {{column_name: file_name}}\nsupplementary_columns: {{}}\ncustom_columns: []\n"
    a = text.format(body="text", url="u", label="l", title="title")
    b = text.format(body="content", url="u", label="l", title="headline")
    (tmp_path / "configs" / "a.parquet.yml").write_text(a)
    spark.createDataFrame([("b1", "t1", "u1", "x")], "text string, title string, u string, l string").write.parquet(
        f"{folder}/a.parquet"
    )
    spark.createDataFrame([("b2", "t2", "u2", "x")], "content string, headline string, u string, l string").write.parquet(
        f"{folder}/b.parquet"
    )
    jobs.ingest_dataset(spark, f"{folder}/*", configs, table, RUN)  # one config: the other dataset is foreign
    assert column(spark.read.parquet(table), "body") == ["b1"]
    rejected = spark.read.parquet(f"{table}_rejected").collect()
    assert len(rejected) == 1 and '"content":"b2","headline":"t2"' in rejected[0]["row"]
    (tmp_path / "configs" / "b.parquet.yml").write_text(b)
    jobs.ingest_dataset(spark, f"{folder}/*", configs, table, RUN)
    assert sorted(column(spark.read.parquet(table), "title")) == ["t1", "t2"]
    spark.read.parquet(f"{folder}/a.parquet").write.parquet(f"{other}/a.parquet")
    jobs.ingest_dataset(spark, f"{other}/*", configs, table, RUN)  # another source with the same stamp
    assert sorted(column(spark.read.parquet(table), "title")) == ["t1", "t1", "t2"]


def test_schema_contract(config, source):
    df = source.drop("site_url").withColumn("type", F.lit(1))
    contract = {r["standard_column"]: r for r in mapping.schema_contract(df, config).collect()}
    assert contract["url"]["status"] == "absent" and contract["url"]["n_missing"] == 2
    assert contract["label"]["status"] == "wrong type"
    assert contract["body"]["status"] == "present" and contract["body"]["n_missing"] == 1
    assert contract["title"]["n_missing"] == 1


def test_drop_empty_text(source):
    assert ingest.drop_empty_text(source, "title").count() == 1
    counts = {r["column_name"]: (r["n_before"], r["n_after"]) for r in
              ingest.row_counts_before_after(source, "title", "text").collect()}
    assert counts == {"title": (2, 1), "text": (2, 2)}


def plain_config(**columns):
    names = {"body": "text", "url": "u", "label": "l", "title": "title", "file_name": "file_name", **columns}
    return MappingConfig(names, {"publication_date": "year"}, ("extra",))


def write_rows(folder, name, count=1, **columns):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    data = {"text": "b", "title": "t", "u": "u", "l": "x", **columns}
    pq.write_table(pa.table({k: [v] * count for k, v in data.items() if v is not None}), folder / name)


def mapped(spark, folder, configs):
    accepted, rejected = jobs.map_files(catalogue.list_files(spark, str(folder)), configs, RUN)
    return accepted, rejected


def test_partition_folders_belong_to_their_dataset(spark, tmp_path):
    write_rows(tmp_path, "a.parquet/year=2020/part-0.parquet")
    write_rows(tmp_path, "a.parquet/year=2021/month=1/data.parquet")  # named otherwise, and one more level
    write_rows(tmp_path, "odd +name%20é.parquet", extra=7)
    write_rows(tmp_path, "foreign.parquet/year=2019/part-0.parquet")
    write_rows(tmp_path, "sub/folder/part-1.parquet", title=None)
    configs = {name: plain_config() for name in ("a.parquet", "odd +name%20é.parquet", "folder")}
    accepted, rejected = mapped(spark, tmp_path, configs)
    assert rows(accepted.select("file_name", "publication_date", "custom_columns")) == [
        ("a.parquet", "2020", '{"extra":"null"}'),
        ("a.parquet", "2021", '{"extra":"null"}'),
        ("odd +name%20é.parquet", "null", '{"extra":7}'),
    ]
    assert rows(rejected) == [
        ("missing mandatory column: title", '{"text":"b","u":"u","l":"x","file_name":"folder"}'),
        ("no mapping config", '{"text":"b","title":"t","u":"u","l":"x","year":2019,"file_name":"foreign.parquet"}'),
    ]


def test_files_of_one_dataset_may_differ_in_columns(spark, tmp_path):
    write_rows(tmp_path, "a.parquet/part-0.parquet", extra=1)
    write_rows(tmp_path, "a.parquet/part-1.parquet", extra="one")
    write_rows(tmp_path, "a.parquet/part-2.parquet")
    write_rows(tmp_path, "a.parquet/part-3.parquet", count=0)
    accepted, rejected = mapped(spark, tmp_path, {"a.parquet": plain_config()})
    found = sorted(column(accepted, "custom_columns"))
    assert found == ['{"extra":"null"}', '{"extra":"one"}', '{"extra":1}'] and rejected.count() == 0


def test_plan_does_not_grow_with_the_files(spark, tmp_path):
    sizes = []
    for folder, count in (("few", 3), ("many", 60)):
        for i in range(count):
            write_rows(tmp_path / folder, f"set-{i}.parquet")  # each file a dataset of its own
            write_rows(tmp_path / folder, f"other.parquet/part-{i}.parquet", extra="e")
        configs = {f"set-{i}.parquet": plain_config() for i in range(count)}
        accepted, rejected = mapped(spark, tmp_path / folder, configs)
        assert len(set(column(accepted, "file_name"))) == count
        assert rejected.count() == count
        plan = accepted.unionByName(rejected, allowMissingColumns=True)._jdf.queryExecution().optimizedPlan()
        sizes.append(plan.toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_nothing_to_ingest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        mapped(spark, tmp_path, {})
