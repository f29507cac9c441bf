"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: The tables of each scratch() that is open, the innermost last.
_OPEN: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())
#: Where tables are written, while somebody holds them.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one, in local mode only.

    On a cluster the executors wouldn't see such a folder, so that an unset spark.checkpoint.dir is a ValueError there.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not found and not is_local(spark):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="eventloom-"))
    return found or context.getCheckpointDir()


def _found(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reads."""
    at, files = _found(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table; no error if it is gone."""
    at, files = _found(spark, path)
    files.delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those with keep, which go to the scratch() around, if any.

    What is computed inside and read later must be written with keep.
    """
    mine: list[tuple[SparkSession, str]] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for spark, path in mine:
            remove(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. keep: see scratch()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owners = _OPEN.get()[: -1 if keep else None]
    if owners:
        owners[-1].append((spark, path))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def forget(table: DataFrame) -> None:
    """Deletes a table that written() returned, which nothing reads any more; other DataFrames are left alone."""
    if (path := _PATHS.pop(table, None)) is not None:
        remove(table.sparkSession, path)
