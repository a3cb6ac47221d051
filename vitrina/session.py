"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing = [0]  # tables being written under a clean-up setting of ours


def local_session(cpus: str = "8", app: str = "vitrina", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may fall back to a folder of its own: a machine-local path would not be
    visible to the executors of a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="vitrina-")


def working_folder(spark: SparkSession) -> str:
    """The folder of this application's working tables."""
    return f"{shared_folder(spark)}/vitrina/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a working table."""
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_working_tables(spark: SparkSession) -> None:
    """Delete this application's working tables, once no DataFrame or model reads them any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(working_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete working tables that ``materialize`` returned, once everything that is made of them has been written."""
    for table in tables:
        spark = table.sparkSession
        context = spark.sparkContext
        own = f"{working_folder(spark)}/".split(":", 1)[-1].lstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(own):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffle_clean_up(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files at its end, unless the session has a setting of its own."""
    with _lock:
        ours = bool(_writing[0]) or spark.conf.get(_CLEAN_UP, None) is None
        if ours:
            spark.conf.set(_CLEAN_UP, "true")
            _writing[0] += 1
    try:
        yield
    finally:
        with _lock:
            if ours:
                _writing[0] -= 1
                if not _writing[0]:
                    spark.conf.unset(_CLEAN_UP)


def materialize(
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
    read_as: StructType | None = None,
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, keeps column pruning and filter pushdown
    for the readers, and gives the planner the real size of the table. ``read_as`` replaces the
    schema it is read with. Shuffle files of the write go as soon as the table is complete.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffle_clean_up(spark):
        writer.parquet(path)
    return spark.read.schema(read_as or df.schema).parquet(path)
