"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written and not dropped.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a local one only where Spark itself is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df once and reads it back: an iterative plan stays flat, and lost executors lose no part of it. by: a column with a folder for each value."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this process has written, but for the first since; call it when no result that reads them is needed any more."""
    for path in _PATHS[since:]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _PATHS[since:]


@contextlib.contextmanager
def temporary_tables(spark: SparkSession):
    """Tables written inside are dropped at the end; results have to be read or written before."""
    since = len(_PATHS)
    try:
        yield
    finally:
        drop_tables(spark, since)
