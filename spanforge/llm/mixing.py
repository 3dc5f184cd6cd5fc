"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Sources in code point order, null last, weigh WEIGHTS in turn and share BUDGET_SHARE of all
words; no target passes MAX_REPEATS times its source's words, and what it leaves is shared
again by weight among the rest. That fixed point is closed-form: target = least(cap, level *
weight), where the level follows from the sources sorted by cap / weight.

Each source's documents are shuffled by a hash of their id. A document's virtual finish
time is the source's words up to and with it, divided by the source's target; the second
pass over a source goes on where the first ends. All passes are range-sorted by finish time
and cut where the words taken reach the budget. So every source is served in proportion to its
target, and ends within a document of it.

Rules for odd input: a null or wordless text has size 0 and is never taken; null sources are
one source; rows with equal ids are documents of their own; very long texts are only counted, in the JVM; further columns
of the caller travel in one struct, whatever their names; an empty table gives an empty
result. Ties in finish time are broken by source, pass, hash and id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keeping_columns, materialise, unique_ids
from .running import running_total, same

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
SEED = 17


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def shuffle_key(seed: int = SEED):
    """A pseudo-random order of ids that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, size) to one row a source: source, rank, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_total(per, [], ["source"], "__one", "rank").drop("__one")  # range-sorted, as there may be as many sources as hosts
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = running_total(rows, [], ["ratio", "rank"], "cap", "caps")
    rows = running_total(rows, [], ["ratio", "rank"], "weight", "weights")
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # the level if this source and all with larger ratios are below their caps
    rows = rows.withColumn("level", (F.lit(float(whole[0])) - (F.col("caps") - F.col("cap"))) / (F.lit(float(whole[1])) - (F.col("weights") - F.col("weight"))))
    best = rows.filter("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level")).alias("b")).first()["b"]
    level = F.lit(None if best is None else best["level"]).cast("double")
    # rounding alone can leave no source under the level: then all are at their caps
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, size, more) to the same rows with source_size, target and passes (times taken, 0 to repeats)."""
    docs = materialise(docs, "sizes")  # texts are read and counted once
    shuffled = docs.withColumn("__h", shuffle_key(seed))
    targets = source_targets(docs.select("source", "size"), weights, share, repeats)
    cum = running_total(shuffled, ["source"], ["__h", "doc_id", "size"], "size", "__cum", targets)
    finish = lambda k: F.coalesce(F.try_divide(F.col("__cum") + F.lit(k) * F.col("source_size"), F.col("target")), F.lit(0.0))
    order = ["finish", "rank", "pass", "__cum", "__h", "doc_id"]
    turn = lambda k: F.struct(finish(k).alias("finish"), F.col("rank"), F.lit(k).alias("pass"), F.col("__cum"), F.col("__h"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"))
    turns = cum.filter("size > 0").select("size", F.inline(F.array(*(turn(k) for k in range(repeats)))))
    total = running_total(turns, [], order, "size", "__total")
    budget = docs.agg((F.sum("size") * share).alias("b")).first()["b"] or 0.0
    last = total.filter(F.col("__total") <= budget).agg(F.max(F.struct(*order)).alias("t")).first()["t"]
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        types = dict(total.dtypes)
        limit = F.struct(*(F.lit(last[c]).cast(types[c]).alias(c) for c in order))
        taken = sum((turn(k) <= limit).cast("long") for k in range(repeats)) * (F.col("size") > 0).cast("long")
    return cum.withColumn("passes", taken).drop("__h", "__cum", "rank")


def mix_counts(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = docs.select("doc_id", "source", word_count().alias("size"))
    return mix(sizes, **kw).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


@keeping_columns
def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    names = docs.columns
    keyed = docs.withColumns({"__t": F.lit(0).cast("long"), "__n": F.lit(0)})
    if not unique_ids(docs):  # tell rows of one id apart by text, and equal rows by number
        keyed = docs.withColumn("__t", F.xxhash64("text"))
        keyed = keyed.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", "source", "__t").orderBy("__t")))
    sizes = keyed.select("doc_id", "source", "__t", "__n", word_count().alias("size"))
    passes = mix(sizes, **kw).filter("passes > 0").select(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("__t").alias("__u"), F.col("__n").alias("__m"), "passes")
    passes = passes.withColumnRenamed("passes", "__p")
    on = same(keyed, passes, [("doc_id", "__i"), ("source", "__s"), ("__t", "__u"), ("__n", "__m")])
    joined = keyed.join(passes, on)
    return joined.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__p")))).select(*names)
