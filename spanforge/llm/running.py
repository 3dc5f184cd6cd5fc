"""Running totals and ranks over any order without one task per group (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs, which Spark still plans as an equi-join."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, by_group: DataFrame | None = None) -> DataFrame:
    """df with column out: the sum of value over the rows of its group up to and with this one, by order.

    The rows are range-sorted over group and order, so a hot group spreads over many
    partitions; each partition's sum per group is a small table, whose prefix sums are the
    partitions' offsets. The ranged rows are written once to the shared folder: both passes then
    see the same partitions, whatever executors are lost. Nulls sort last and form one group.
    by_group: columns to add to each row of a group, joined to the small table.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    ranged = materialise(df.repartitionByRange(*keys).withColumn("__pid", F.spark_partition_id()), "ranged")
    offsets = ranged.groupBy(*group, "__pid").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    if by_group is not None:
        named = by_group.withColumnsRenamed({c: f"__by_{c}" for c in group})
        offsets = offsets.join(named, same(offsets, named, [(c, f"__by_{c}") for c in group])).drop(*(f"__by_{c}" for c in group))
    offsets = offsets.withColumnsRenamed({c: f"__of_{c}" for c in [*group, "__pid"]})
    own = W.partitionBy("__pid", *group).orderBy(*(F.col(c).asc_nulls_last() for c in order)).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn(out, F.sum(value).over(own))
    joined = local.join(offsets, same(local, offsets, [(c, f"__of_{c}") for c in ["__pid", *group]]))
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__before", "__pid", *(f"__of_{c}" for c in ["__pid", *group]))
