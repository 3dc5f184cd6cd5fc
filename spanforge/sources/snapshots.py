"""Versioned sources: commits that add, change and delete files at once, or not at all.

A store is a folder. A commit first writes its changes as immutable data (rows uri, text, deleted); only then does it create
the manifest of the next version, a small file that lists the data folders the version is made of, oldest first. Creating that file fails if it
exists, so of two writers on one version one is refused; a commit that fails before leaves data that no manifest names, and
the old version as it was. Reading takes for each file its row in the last folder that has it. ``roll_back`` and ``compact`` are commits too.

Repeated changes of one file in a commit count as the one with the largest text, a deletion only if all of them are deletions; a null uri is refused.
Scale: changes are written by the job that makes them; a version reads all its folders and keeps one row a file (one shuffle); ``compact`` brings them back to one folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "uri string, text string, deleted boolean"


class Conflict(RuntimeError):
    """The store has moved on from the version that a commit expected."""


def _path(spark: SparkSession, name: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """The last version of a store; 0 is the empty store."""
    fs, p = _path(spark, f"{root}/manifests")
    if not fs.exists(p):
        return 0
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.getLen()]
    return max((int(x) for x in found if x.isdigit()), default=0)


def _folders(spark: SparkSession, root: str, at: int) -> list[str]:
    if not at:
        return []
    fs, p = _path(spark, f"{root}/manifests/{at:010d}")
    if not fs.exists(p):
        raise ValueError(f"no version {at}")
    stream = fs.open(p)
    try:
        body = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(body)["folders"]


def _swap(spark: SparkSession, root: str, expected: int, folders: list[str]) -> int:
    """Makes folders the next version, if expected is still the last one."""
    if version(spark, root) != expected:
        raise Conflict(f"expected version {expected}, found {version(spark, root)}")
    fs, p = _path(spark, f"{root}/manifests/{expected + 1:010d}")
    try:
        stream = fs.create(p, False)  # fails if another writer was first
    except Exception as e:
        raise Conflict(f"version {expected + 1} exists") from e
    try:
        stream.write(bytearray(json.dumps({"version": expected + 1, "folders": folders}).encode()))
    finally:
        stream.close()
    return expected + 1


def commit(changes: DataFrame, root: str, expected: int) -> int:
    """Writes changes (uri, text; a null text deletes) as the version after expected and returns it; raises Conflict if there is one already."""
    spark = changes.sparkSession
    folders = _folders(spark, root, expected)
    once = changes.groupBy(F.when(F.col("uri").isNull(), F.raise_error(F.lit("a change without a uri"))).otherwise(F.col("uri")).alias("uri")).agg(F.max("text").alias("text"))
    name = uuid.uuid4().hex
    once.select("uri", "text", F.col("text").isNull().alias("deleted")).write.parquet(f"{root}/data/{name}")
    return _swap(spark, root, expected, [*folders, name])


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The files (uri, text) of a version, the last one by default."""
    out = None
    for k, name in enumerate(_folders(spark, root, version(spark, root) if at is None else at)):
        part = spark.read.schema(_DATA).parquet(f"{root}/data/{name}").withColumn("turn", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "uri string, text string")
    last = out.groupBy("uri").agg(F.max_by(F.struct("text", "deleted"), "turn").alias("x"))
    return last.filter("not x.deleted").select("uri", "x.text")


def roll_back(spark: SparkSession, root: str, to: int, expected: int) -> int:
    """A version that is what an earlier one was."""
    return _swap(spark, root, expected, _folders(spark, root, to))


def compact(spark: SparkSession, root: str, expected: int) -> int:
    """The same files in one folder."""
    name = uuid.uuid4().hex
    read(spark, root, expected).withColumn("deleted", F.lit(False)).write.parquet(f"{root}/data/{name}")
    return _swap(spark, root, expected, [name])
