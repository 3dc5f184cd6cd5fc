"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each.

The exact histogram of all lengths up to the budget (at most one bin for each length, so its
size is bounded by the budget) goes to the driver, where dynamic programming with a convex hull
chooses the N_BUCKETS upper edges that minimise all padding; of equally good ones it takes those whose
lower neighbours are longest. Documents of a bucket, shuffled by a hash, are dealt to
batches of budget // edge documents, so a padded batch keeps the budget. Documents longer than the budget form
a last bucket, in which each is an unpadded batch by itself.

Rules for odd input: null or wordless texts have length 0 and go to the first bucket;
rows with equal ids are packed one by one, in the order of their hash, id and length (ties are equal rows); very long texts
are counted in the JVM without a list of words; columns beside doc_id and text aren't read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .mixing import SEED, shuffle_key, word_count
from .running import running_total

N_BUCKETS = 16
BUDGET = 32_768


def best_edges(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper edges (a subset of lengths, ascending) of at most so many buckets with the least sum of edge * count; ties: the longest edge below, from the top down."""
    edge = [int(x) for x in lengths]
    n = [0, *np.cumsum(counts, dtype=object).tolist()]
    m = len(edge)
    cost: list = [0] + [None] * m
    choice = []
    for _ in range(min(buckets, m)):
        new: list = [0] + [None] * m
        come = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i): cost of ending the bucket before at i
        at = 0
        for j in range(1, m + 1):
            if cost[j - 1] is not None:
                line = (-n[j - 1], cost[j - 1], j - 1)
                while len(hull) - at >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            value = lambda h: h[0] * edge[j - 1] + h[1]
            while len(hull) - at >= 2 and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            new[j] = edge[j - 1] * n[j] + value(hull[at])
            come[j] = hull[at][2]
        choice.append(come)
        done = cost[m] is not None and new[m] >= cost[m]
        cost = new
        if done:
            break
    out, j = [], m
    for come in reversed(choice):
        if not j:
            break
        out.append(edge[j - 1])
        j = come[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = N_BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """docs (doc_id, n_tokens) to doc_id, n_tokens, bucket, padded_tokens, batch (within the bucket), slot."""
    rows = materialise(docs.select("doc_id", "n_tokens"), "lengths")
    histogram = rows.filter(F.col("n_tokens") <= budget).groupBy("n_tokens").count().orderBy("n_tokens").collect()  # budget + 1 rows at most
    edges = best_edges([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], buckets)
    at = F.lit(0)
    for e in edges:
        at = at + (F.col("n_tokens") > e).cast("int")
    top = F.get(F.array(*(F.lit(int(e)).cast("long") for e in edges)).cast("array<long>"), F.col("bucket"))
    rows = rows.withColumn("bucket", at).withColumn("padded_tokens", F.coalesce(top, F.col("n_tokens"))).withColumns({"__h": shuffle_key(seed), "__one": F.lit(1).cast("long")})
    ranked = running_total(rows, ["bucket"], ["__h", "doc_id", "n_tokens"], "__one", "__rank")
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("padded_tokens", F.lit(1))))
    place = F.col("__rank") - 1
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_tokens", F.floor(place / each).alias("batch"), (place % each).alias("slot"))


def pack_documents(docs: DataFrame, **kw) -> DataFrame:
    """Packs documents by their word counts."""
    return pack(docs.select("doc_id", word_count().alias("n_tokens")), **kw)
