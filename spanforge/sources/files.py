"""File sources: whole files by file: URI, with their language and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, language_of


def check_uri(uri: str) -> str:
    """Only absolute file: URIs are read."""
    if not uri.startswith("file:///"):
        raise ValueError(f"not an absolute file URI: {uri}")
    return uri


def read_sources(spark: SparkSession, *uris: str, pattern: str | None = None) -> DataFrame:
    """Whole text files to (uri, lang, text, content_hash)."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.text([check_uri(u) for u in uris], wholetext=True).withColumn("uri", F.col("_metadata.file_path"))
    return df.select("uri", language_of("uri").alias("lang"), F.col("value").alias("text"), content_hash("value").alias("content_hash"))


def write_sources(df: DataFrame, path: str) -> None:
    """Contents as a table; the write is atomic as a whole through Spark's commit protocol."""
    df.select("uri", "text").write.mode("errorifexists").parquet(path)


def spread(sources: DataFrame, by: str = "uri") -> DataFrame:
    """sources over all cores, for parsing: dealt anew by their uri if they come from fewer files than there are cores, as they are otherwise."""
    spark = sources.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(sources.inputFiles()) >= cores:
        return sources
    return sources.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)
