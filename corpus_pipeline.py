"""From documents to packed training batches: five stages, each written and read again.

Quality rules reject documents and cut frequent lines; of each group of near-duplicates one
document stays; word windows that earlier documents hold are cut; sources are mixed to
their target weights; what is left is packed into token-budget batches.

Odd input: documents without ten words, null and empty texts among them, go in the first stage; documents with a
null id pass near-duplicate and substring removal untouched; rows with equal ids are documents of their own, but
equal rows of one id stay once after near-duplicate removal; a null source is a source; very long texts are worked on in
parts; columns beside those of documents stay with their rows until packing, whatever their names; an empty
table gives an empty result. A stage's intermediate tables are dropped once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import common, minhash, mixing, packing, quality, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Near-duplicate components can't be stated in SQL at corpus scale; tests/llm compares
#: the pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = common.written()
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        common.drop_tables(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
