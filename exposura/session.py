"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STORED: list[str] = []
# Where each table of ``materialize`` lies, for ``discard``.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
# Tables that queries of one application share: what they are made of -> where they are, and their columns.
_SHARED: dict[Hashable, tuple[str, StructType]] = {}


def release_stored(spark: SparkSession) -> int:
    """Delete everything ``materialize`` has stored so far, once results that read it are written; returns how many."""
    _SHARED.clear()
    count = len(_STORED)
    while _STORED:
        _delete(spark, _STORED.pop())
    return count


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later step reads, nor a result that is still to be computed."""
    for table in tables:
        path = _PLACES.pop(table)
        _STORED.remove(path)
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; nothing reads them again, since the result is stored."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/exposura-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps read the same result: it cuts the plan, survives lost executors,
    and later steps get a columnar scan with pruned columns and a known size. What is stored stays until
    ``release_stored`` or ``discard``, because results are lazy and may still be read. Shuffle files behind it go at once.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _PLACES[stored] = path
    return stored


def file_stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files behind a table, so that a changed table is told from the old one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(conf).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def stored_once(spark: SparkSession, made_of: Hashable, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """The stored table of ``made_of``, built and written at its first use in this application, partitioned for pruning.

    Checks inside the plan of ``build`` run while it is written; later reads are plain scans, so filters and column
    lists of each query reach the files, and filters on ``partition_by`` decide which folders are listed at all.
    """
    key = (spark.sparkContext.applicationId, made_of)
    if key not in _SHARED:
        path, df = _new_path(spark), build()
        with _shuffles_removed(spark):
            df.write.partitionBy(*partition_by).parquet(path)
        _SHARED[key] = path, df.schema
    path, schema = _SHARED[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)
