"""Deltas: new diagnostics, changed edges, latest directives, consecutive groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIAGNOSTIC_KEYS = ("line", "character", "severity", "message", "code")


def severe(diagnostics: DataFrame) -> DataFrame:
    """Errors (1), warnings (2) and diagnostics without a severity."""
    return diagnostics.filter("severity is null or severity in (1, 2)")


def anti_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of left whose keys, nulls equal, are not in right; duplicates stay."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(named[f"__{k}"])
    return left.join(named, cond, "left_anti")


def new_diagnostics(baseline: DataFrame, updated: DataFrame, keys=DIAGNOSTIC_KEYS) -> DataFrame:
    """Severe diagnostics after a change that weren't there before."""
    return anti_join(severe(updated), severe(baseline), keys)


def latest_by(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each key's value in its last row by order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def set_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys with change: added, removed or kept."""
    b = before.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct().withColumn("__b", F.lit(1))
    a = after.select(*keys).distinct().withColumn("__a", F.lit(1))
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"__{k}"])
    joined = a.join(b, cond, "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("kept")
    out = [F.when(F.col("__a").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.select(*out, change.alias("change"))


def consecutive_groups(df: DataFrame, partition: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """df with group (0, 1, ...): a row joins the group before it if it starts at most gap after the furthest end so far."""
    order = W.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("group", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")


# -- history -----------------------------------------------------------------------------

# Weights of the evidence that two symbols are one, and the offset of its logistic.
MATCH_WEIGHTS = {"name": 3.0, "container": 1.0, "kind": 1.0, "signature": 2.0}
MATCH_OFFSET = -3.5


def match_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol_id, name, container, kind, signature) of two versions to before_id, after_id, phase, probability.

    Phases: equal ids; equal name, container and kind; equal signature and kind. Each phase only
    sees what earlier ones left, and keeps pairs that are unique on both sides.
    """
    names = ["symbol_id", "name", "container", "kind", "signature"]
    b, a = (df.select(*(F.col(n).alias(f"{p}_{n}") for n in names)) for df, p in ((before, "b"), (after, "a")))
    out = None
    for phase, keys in enumerate((["symbol_id"], ["name", "container", "kind"], ["signature", "kind"])):
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}"))
        one_b = b.withColumn("nb", F.count("*").over(W.partitionBy(*(f"b_{k}" for k in keys)))).filter("nb = 1").drop("nb")
        one_a = a.withColumn("na", F.count("*").over(W.partitionBy(*(f"a_{k}" for k in keys)))).filter("na = 1").drop("na")
        found = one_b.join(one_a, cond).withColumn("phase", F.lit(phase))
        out = found if out is None else out.unionByName(found)
        b = b.join(found.select(F.col("b_symbol_id").alias("__x")), F.col("b_symbol_id") == F.col("__x"), "left_anti")
        a = a.join(found.select(F.col("a_symbol_id").alias("__x")), F.col("a_symbol_id") == F.col("__x"), "left_anti")
    score = sum((F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}"))).cast("double") * w for k, w in MATCH_WEIGHTS.items()) + MATCH_OFFSET
    return out.select(F.col("b_symbol_id").alias("before_id"), F.col("a_symbol_id").alias("after_id"), "phase", (1 / (1 + F.exp(-score))).alias("probability"))
