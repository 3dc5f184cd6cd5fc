"""Span predicates between two sets of byte spans of the same files, as sorted sweeps.

A containment or overlap join plans as an equi-join on the file with a residual range
condition, which is quadratic in a file's spans. Where only existence counts, one
shuffle by file and a running maximum (or minimum) over the spans in order decides it in
linear time and is spilled by the sort like any other window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _marked(anchors: DataFrame, others: DataFrame) -> DataFrame:
    """anchors with __s, __e, and rows of others (own columns null), ordered together."""
    a = anchors.withColumns({"__own": F.lit(1), "__s": F.col("start_byte"), "__e": F.col("end_byte")})
    o = others.select("uri", F.lit(0).alias("__own"), F.col("start_byte").alias("__s"), F.col("end_byte").alias("__e"))
    return a.unionByName(o, allowMissingColumns=True)


def _done(rows: DataFrame, anchors: DataFrame, keep) -> DataFrame:
    return rows.filter((F.col("__own") == 1) & keep).select(*anchors.columns)


def contained(anchors: DataFrame, contexts: DataFrame, negate: bool = False) -> DataFrame:
    """Anchors (uri, start_byte, end_byte, ...) inside some context; negate: inside none."""
    rows = _marked(anchors, contexts)
    # of contexts that start no later, the largest end
    before = W.partitionBy("uri").orderBy("__s", "__own").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("__own") == 0, F.col("__e"))).over(before)
    inside = F.coalesce(reach >= F.col("__e"), F.lit(False))
    return _done(rows.withColumn("__in", inside), anchors, ~F.col("__in") if negate else F.col("__in"))


def overlapping(anchors: DataFrame, others: DataFrame, negate: bool = False) -> DataFrame:
    """Anchors that share a byte with some other span; negate: with none."""
    rows = _marked(anchors, others)
    before = W.partitionBy("uri").orderBy("__s", "__own").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("uri").orderBy(F.col("__s").desc(), "__own").rowsBetween(W.unboundedPreceding, 0)
    other = F.col("__own") == 0
    reach = F.max(F.when(other, F.col("__e"))).over(before)
    ahead = F.min(F.when(other & (F.col("__s") < F.col("__e")), F.col("__s"))).over(after)
    hit = F.coalesce(reach > F.col("__s"), F.lit(False)) | F.coalesce(ahead < F.col("__e"), F.lit(False))
    return _done(rows.withColumn("__hit", hit), anchors, ~F.col("__hit") if negate else F.col("__hit"))


def innermost(points: DataFrame, intervals: DataFrame, key: str = "uri", point: str = "at") -> DataFrame:
    """For each point the smallest interval that holds it (ties: first in order), or nulls.

    points (key, point, ...), intervals (key, start_byte, end_byte, ord, ...).
    """
    columns, named = points.columns, intervals.withColumnsRenamed({key: "__key"})
    # equal points are points of their own: each gets a number among its equals before the join
    points = points.withColumn("__twin", F.row_number().over(W.partitionBy(*columns).orderBy(F.lit(0))))
    joined = points.join(named, (points[key] == named["__key"]) & (F.col("start_byte") <= F.col(point)) & (F.col(point) < F.col("end_byte")), "left").drop("__key")
    best = W.partitionBy(*columns, "__twin").orderBy((F.col("end_byte") - F.col("start_byte")).asc_nulls_last(), "ord")
    return joined.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn", "__twin")
