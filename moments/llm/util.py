"""Shared folder, staged tables and small column helpers of the subpackage.

Intermediate results are written as Parquet tables into the shared folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs at most the tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see. Only a local session may fall back to a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"moments-shared-{os.getpid()}")
    if not os.path.isdir(path):
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + path)
    return "file://" + path


#: Rows, and bytes but for the last row, that a Python worker gets at a time, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Groups of fewer bytes aren't followed by a trim.
GROUP_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds what Python workers hold, and frees the shuffle files of each finished action at once.

    The settings are made once and never taken back or raised, so operators that run at the same time don't disturb each
    other.
    """
    for most, name in ((BATCH_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch"), (BATCH_BYTES, "spark.sql.execution.arrow.maxBytesPerBatch")):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def trimmed(run):
    """The same function over batches, which gives unused memory back at the end of each task; workers live on between tasks.

    Also at its beginning, as the task before may have been of a function over groups, which doesn't see its task's end.
    """

    def then_trim(batches):
        trim()
        yield from run(batches)
        trim()

    return then_trim


def trim_group(size: int) -> None:
    """To be called after each group of so many bytes; small ones leave little behind."""
    if size >= GROUP_BYTES:
        trim()


def trim() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


MADE: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the staged tables of operators begun since MADE had so many entries, once their results have been written."""
    gone = [base for base in MADE[since:] if base not in keep]
    for base in gone:
        _delete(spark, base)
        MADE.remove(base)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A folder of staged tables for one run of an operator. Results read from it, so it stays until ``release``."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        MADE.append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that the operator reads; whatever else the table has can't clash with what it adds."""
    return df.select(*names)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only. Spark's lower() is quicker and does the same to text of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
