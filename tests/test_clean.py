import random

import pytest
from pyspark.sql import functions as F

from newsgraph.operators import clean, sinks
from newsgraph.plans import jobs
from newsgraph.schema import RECORD_COLUMNS
from newsgraph.sources.readers import read_json_batches, read_lines
from tests.helpers import column, rows

STAMPS = "2018-01-25 16:17:44.789555,2018-02-02 01:19:41.756632,2018-02-02 01:19:41.756664"
TITLE = "A headline with quite a few words in it"


def record(head="0,17,site.com,fake,http://site.com/1", body="Some text", stamps=STAMPS, title=TITLE, tail=',"x"'):
    return f'{head},"{body}",{stamps},"{title}"{tail}'


# Hand-written records and the outcome of each.
ODD_RECORDS = [
    (record(), None),
    (record(body='He said "no" twice'), None),
    (record(body=""), None),
    (record(body="two\nlines"), None),
    ('0,1,site.com,fake,u,"never closed', "R1"),
    (record(head="0,1,site.com,fake,http://site.com/a,b"), "R2"),
    (record(head="0,1,site.com,fake"), "R2"),
    (record(stamps="no stamps here"), "R3"),
    (record(stamps="2018-01-25 16:17:44.789555,2018-02-02 01:19:41.756632"), "R4"),
    (record(stamps=STAMPS + ",2018-02-02 01:19:41.756664"), "R4"),
    (f'0,1,site.com,fake,u,"text",{STAMPS}', "R5"),
    (record(title="['not', 'a', 'title', 'at', 'all', 'here']"), "R6"),
    (record(title="[not closed but it is quite long indeed"), None),
    (record(title="ten chars!"), "R7"),
    (record(title="12345678901234 ab cd ef"), "R8"),
    (record(title="Happy Studios, Joan Smith, Bob Johnson, Leslie Brown"), "R9"),
    (record(title="three words only"), "R9"),
    (record(title="four words are enough"), None),
]


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i, text, want) for i, (text, want) in enumerate(ODD_RECORDS)]
    df = spark.createDataFrame(data, "n int, record string, want string")
    return clean.with_parsed_fields(df).orderBy("n").collect()


def test_reject_reasons(odd):
    assert [r["reject_reason"] for r in odd] == [r["want"] for r in odd]


def test_parsed_fields(odd):
    first = odd[0]
    assert [first[c] for c in RECORD_COLUMNS] == [
        "0", "17", "site.com", "fake", "http://site.com/1", "Some text", *STAMPS.split(","), TITLE,
    ]
    assert odd[1]["body"] == "He said no twice"
    assert odd[2]["body"] == ""
    assert odd[3]["body"] == "two\nlines"


def test_counts_and_split_add_up(spark):
    df = spark.createDataFrame([(t,) for t, _ in ODD_RECORDS], "record string")
    accepted, rejected = clean.parse_records(df)
    assert accepted.count() + rejected.count() == len(ODD_RECORDS)
    counts = dict(rows(clean.reject_counts(df)))
    assert counts["accepted"] == accepted.count() == sum(want is None for _, want in ODD_RECORDS)
    assert set(column(rejected, "reject_reason")) == set(clean.REJECT_REASONS)


def write_file(path, n_records, seed, preamble=("index,id,domain", "", "no record"), huge=None):
    """A raw file of records of very different length; returns the text of each record."""
    rng = random.Random(seed)
    texts = []
    for i in range(n_records):
        lines = [f"line {j} of {i}, é" * rng.randint(0, 4) for j in range(rng.choice([1, 1, 2, 5, 40]))]
        if i == huge:
            lines = [f"long line {j} " * 20 for j in range(400)]
        texts.append(f'{i},{1000 + i},site{i % 7}.com,fake,u{i},"' + "\n".join(lines) + '"')
    path.write_text("\n".join([*preamble, *texts]) + "\n", encoding="utf-8")
    return texts


@pytest.mark.parametrize("split_bytes", [3000, 20000, 100 << 20])
def test_assembly_over_block_edges(spark, tmp_path, split_bytes):
    raw = tmp_path / "raw"
    raw.mkdir()
    texts = write_file(raw / "a.csv", 300, 1, huge=150) + write_file(raw / "b.csv", 200, 2, preamble=())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = read_lines(spark, str(raw))
        if split_bytes == 3000:
            assert lines.select("path", "block").distinct().count() > 20
        assembled = clean.assemble_records(lines)
        assert sorted(column(assembled, "record")) == sorted(texts)
        shorter = clean.assemble_records(read_lines(spark, str(raw)), drop_last=True)
        assert sorted(column(shorter, "record")) == sorted(texts[:299] + texts[300:-1])
        # The place of the records follows the order in the file.
        place = assembled.where(F.col("path").endswith("b.csv")).orderBy("block", "ordinal")
        assert column(place, "record") == texts[300:]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)


def test_file_without_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("nothing\nto see\n")
    assert clean.assemble_records(read_lines(spark, str(tmp_path))).count() == 0


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clean")
    lines = [record(head=f"{i},{i % 40},site.com,fake,u{i}", body=f"text {i}\nmore") for i in range(100)]
    (folder / "raw.csv").write_text("\n".join(lines) + "\n")
    accepted, _ = clean.parse_records(clean.assemble_records(read_lines(spark, str(folder))))
    return accepted


def test_last_record_of_a_news_id_wins(parsed):
    last = clean.dedupe_last_wins(parsed)
    assert sorted(int(i) for i in column(last, "idx")) == list(range(60, 100))
    assert last.columns == parsed.columns


@pytest.mark.parametrize("size", [1, 7, 500])
def test_batches_hold_at_most_size_records_and_lose_none(spark, parsed, tmp_path, size):
    last = clean.dedupe_last_wins(parsed)
    path = str(tmp_path / "batches")
    sinks.write_batch_objects(last, path, size)
    sizes = spark.read.text(path, wholetext=True).select(
        F.size(F.map_keys(F.from_json("value", "map<string,string>"))).alias("n")
    )
    assert max(column(sizes, "n")) <= size
    assert rows(read_json_batches(spark, path).select(*RECORD_COLUMNS)) == rows(last.select(*RECORD_COLUMNS))
    sinks.write_json_batches(last.select(*RECORD_COLUMNS), str(tmp_path / "lines"), size)
    read = spark.read.json(str(tmp_path / "lines"))
    assert read.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= size
    assert rows(read.select(*RECORD_COLUMNS)) == rows(last.select(*RECORD_COLUMNS))


def test_reading_indented_legacy_batches(spark, tmp_path):
    (tmp_path / "1.json").write_text(
        '{\n    "17": {\n        "idx": "0",\n        "news_id": "17",\n        "title": "T",\n        "body": "\\u00e9"\n'
        '    },\n    "18": {\n        "idx": "1",\n        "news_id": "18"\n    }\n}\n\n'
    )
    found = {r["news_id"]: r for r in read_json_batches(spark, str(tmp_path)).collect()}
    assert found["17"]["body"] == "é" and found["17"]["url"] is None
    assert found["18"]["idx"] == "1"


def test_required_fields(spark):
    df = spark.createDataFrame(
        [("u", "d", "l", "b"), (None, "d", "l", "b"), ("u", None, "l", "b"), ("u", "d", "", "b"), ("u", "d", "l", None)],
        "url string, domain string, label string, body string",
    )
    assert clean.drop_missing_keys(df).count() == 2  # an empty label is a label


def test_cleaning_job(spark, tmp_path):
    lines = [record(head=f"{i},{i % 5},site.com,fake,u{i}", title="short" if i == 3 else TITLE) for i in range(20)]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    jobs.clean_lines(spark, str(tmp_path / "raw.csv"), str(tmp_path / "json"), str(tmp_path / "rejected"), 2)
    kept = spark.read.json(str(tmp_path / "json"))
    assert sorted(int(i) for i in column(kept, "idx")) == [15, 16, 17, 18, 19]
    rejected = spark.read.parquet(str(tmp_path / "rejected")).first()
    assert (rejected["record"], rejected["reject_reason"]) == (lines[3], "R7")
