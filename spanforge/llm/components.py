"""Connected components by alternating large-star and small-star steps.

First every task replaces its own edges by stars of their spanning forest. Then each step is
a minimum per vertex (a partial aggregate, so a hub's edges are combined before the shuffle)
and an equi-join with it; no neighbour list is ever collected. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the vertex's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    linked = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return linked.select(F.col("m").alias("u"), "v").filter("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and itself, is linked to the smallest. edges: u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
    linked = edges.join(least, F.col("v") == F.col("w"))
    return linked.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.*").filter("u < v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and hash of the edge set: equal when a round changed nothing."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _forests(batches):
    """Stars (u: the smallest id, v) of the components of a task's edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    stars = [(r, x) for x in parent if (r := root(x)) != x]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to one row (id, component) for each vertex with an edge; component is the smallest id."""
    now = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v")
    now = materialise(now.mapInArrow(_forests, "u long, v long"), "edges")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "stars")
        if (new := _state(now)) == state:
            break
        state = new
    # a star for each component: its centre is the smallest
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).union(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
