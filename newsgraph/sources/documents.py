"""Documents in text files, addressable by name: an offset index beside the files, and a lookup that reads ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsgraph.session import package_for_workers
from newsgraph.sources.catalogue import open_file

HEAD = "# "  # a document is this, its name, a line break, and its lines up to the next head
BATCH_BYTES = 8 << 20  # a task of a lookup holds documents of about so many bytes


def document_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``name, file, first_byte, length`` of every document in the text files under ``path``.

    The files are read with a record per document, heads being the separators. Record lengths are added up inside the
    blocks in which the files are read, and the totals of the blocks before are added; no file is gathered.
    """
    records = spark.read.option("lineSep", f"\n{HEAD}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("total"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("record"),
        (F.octet_length("value") + len(HEAD) + 1).cast("long").alias("bytes"),
        F.substring_index("value", "\n", 1).alias("name"),
    )
    in_block = W.partitionBy("file", "block").orderBy("record").rowsBetween(W.unboundedPreceding, -1)
    placed = records.withColumn("inside", F.coalesce(F.sum("bytes").over(in_block), F.lit(0))).drop("bytes")
    blocks = records.groupBy("file", "block").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    # The head before a record was taken as its separator; the record that opens a file still has it, or has no name.
    start = F.col("before") + F.col("inside")
    opening = start == 0
    heads = placed.join(blocks, ["file", "block"]).where(~opening | F.startswith("name", F.lit(HEAD)))
    heads = heads.select(
        F.when(opening, F.substr("name", F.lit(len(HEAD) + 1))).otherwise(F.col("name")).alias("name"),
        "file",
        F.when(opening, F.lit(0)).otherwise(start - len(HEAD)).cast("long").alias("first_byte"),
        "total",
    )
    following = F.lead("first_byte").over(W.partitionBy("file").orderBy("first_byte"))
    return heads.select("name", "file", "first_byte", (F.coalesce(following, "total") - F.col("first_byte")).alias("length"))


def write_document_index(spark: SparkSession, path: str, index_path: str) -> None:
    """The index as Parquet in order of names, so that a lookup reads few row groups."""
    document_offsets(spark, path).sort("name").write.mode("overwrite").parquet(index_path)


def fetch_documents(index: DataFrame, names: DataFrame) -> DataFrame:
    """``name, document`` of the wanted names (column ``name``), read as byte ranges from the text files. A name that the
    index does not have gives no row; a name that is asked for twice gives one."""
    package_for_workers(index.sparkSession)

    def made(names: list[str], found: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(found, pa.string())], ["name", "document"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        try:
            names, found, size = [], [], 0
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if source is not None:
                            source.close()
                        name, source = row["file"], open_file(row["file"], encoded=True)
                    source.seek(row["first_byte"])
                    text = source.read(row["length"]).decode("utf-8")
                    names.append(row["name"])
                    found.append(text.partition("\n")[2].removesuffix("\n"))
                    size += row["length"]
                    if size >= BATCH_BYTES:
                        yield made(names, found)
                        names, found, size = [], [], 0
            if names:
                yield made(names, found)
        finally:
            if source is not None:
                source.close()

    wanted = index.join(names.select("name"), "name", "left_semi").select("name", "file", "first_byte", "length")
    # Ranges of one file follow each other; a range is read by one task, a file by as many as its ranges lie in.
    wanted = wanted.sortWithinPartitions("file", "first_byte")
    return wanted.mapInArrow(read, "name string, document string")
