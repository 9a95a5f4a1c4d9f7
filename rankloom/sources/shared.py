"""Intermediate tables in the folder that all executors share, whole replacement of tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_written: list[str] = []
_scopes = threading.local()  # of each thread: the lists of its open scopes, innermost last

#: Most bytes of values that `joined` sends to every executor; a hash table of them takes some three times as much.
MOST_BYTES = 64 * 2**20


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only on a local master, where it may be unset (tests), a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def work_folder(spark: SparkSession) -> str:
    """A new folder among the stored tables: it goes when they go."""
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)  # at the latest when the driver ends
    (getattr(_scopes, "open", None) or [_written])[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again.

    It cuts the lineage as checkpoint() does, but in columns and compressed, and a lost executor
    costs no more than reading the file again. The table goes with drop_stored, with the scope it
    was written in, or when the driver ends.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def drop(table: DataFrame) -> None:
    """Deletes a table that `stored` gave, ahead of its scope's end: for steps whose successor is written."""
    fs, path = file_system(table.sparkSession, table._stored_at)
    fs.delete(path, True)


def _drop(spark: SparkSession, paths: list[str]) -> int:
    n = 0
    while paths:
        fs, path = file_system(spark, paths.pop())
        n += fs.delete(path, True)
    return n


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that `stored` has written in this process outside of scopes; results that rest on them are void from then on."""
    return _drop(spark, _written)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes within, in this thread, are deleted at the end: for work whose results are written or collected within."""
    stack = _scopes.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        _drop(spark, stack.pop())


def replace(df: DataFrame, path: str) -> None:
    """Writes df in place of the table at path, whole or not at all: beside it, under a name that readers pass over, then renamed."""
    spark = df.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    fs, new = file_system(spark, aside)
    try:
        df.write.parquet(aside)
        _, old = file_system(spark, path)
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"cannot rename {aside} to {path}")
    finally:
        fs.delete(new, True)


def _width(c: Column, kind: DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (StringType, BinaryType)):
        n = F.octet_length(c)
    elif isinstance(kind, ArrayType):
        n = F.aggregate(c, F.lit(0), lambda a, x: a + _width(x, kind.elementType))
    elif isinstance(kind, MapType):
        n = _width(F.map_keys(c), ArrayType(kind.keyType)) + _width(F.map_values(c), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        n = sum((_width(c[f.name], f.dataType) for f in kind), F.lit(0))
    else:
        n = F.lit(0)
    return F.coalesce(n, F.lit(0)) + 16


def bytes_of(df: DataFrame) -> int:
    """How much room the values of df take, about: measured on all rows."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def most_bytes(spark: SparkSession) -> int:
    """MOST_BYTES, but no more than a thirtieth of an executor's memory."""
    text = spark.sparkContext.getConf().get("spark.driver.memory" if is_local(spark) else "spark.executor.memory", "1g")
    return min(MOST_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) // 30)


def joined(large: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", *, most: int | None = None) -> DataFrame:
    """large joined with small, which is sent to all executors only if measured and found small.

    small should be a stored table, as it is measured first. Beyond `most` bytes (None: most_bytes)
    it is an ordinary join, for which Spark picks the way.
    """
    fits = bytes_of(small) <= (most_bytes(small.sparkSession) if most is None else most)
    return large.join(F.broadcast(small) if fits else small, on, how)
