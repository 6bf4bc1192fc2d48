"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_shared: list[str] = []  # scratch folders of this process in the shared folder


def build_session(app_name: str = "newsgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # No Python stack capture per Column call; plans here have many expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def package_for_workers(spark: SparkSession) -> None:
    """Let Python workers find this package also when the driver was started from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables.

    On a cluster it lies in the shared folder named by ``spark.checkpoint.dir``. Only a local session may fall
    back to a temporary folder of the machine, which is removed when the process ends.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if base:
        path = f"{base.rstrip('/')}/newsgraph/{name}-{uuid.uuid4().hex}"
        _shared.append(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix=f"newsgraph-{name}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"{path}/data"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several outputs need to the scratch folder once, and read it from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder in any store that Spark can reach; nothing happens if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file, in any store that Spark can reach; a folder, a glob or nothing does not."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file, such as a config, written by the driver to any store that Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside the block when it ends, also after a failure."""
    before = len(_shared)
    try:
        yield
    finally:
        clean_scratch(spark, before)


def clean_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Delete the intermediate tables that this process has written to the shared folder, but for the first ``keep``."""
    while len(_shared) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(_shared.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
