"""Best-first slices around many entry symbols at once.

Each slice is what a priority queue would build: the entry, then always the candidate with the best score, until cards, edges or
tokens are spent. All queues are one table (slice, candidate), and a round takes from each the candidates that a queue would pop
next whatever it finds on the way: the best one, and those after it that score more than anything that can be
pushed by those before them. What the edges of a node can bring at most is known beforehand, so rounds are few where scores fall fast.

A candidate's score is fixed when it is pushed: confidence of the edge, fan-in and tokens of the symbol, its depth, and
whether its module is new to the slice by then. Equal scores go by id. A candidate that would pass the token budget is spilled, and the next
one is tried; what is left when a slice is full or done is spilled too.

Scale: a round is one ranking of at most max_cards candidates a slice (kept small before the shuffle), one join of what was taken with its edges (others
are left out by FLAGS flags before anything is shuffled), and a merge of candidates by (slice, symbol). Rounds are written, so lost executors cost no round again; there are 1 + max_cards at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .slices import SliceRequest

#: Weights of a candidate's score.
WEIGHTS = {"confidence": 1.0, "fan_in": 0.3, "proximity": 0.5, "novelty": 0.2, "cost": -0.001}

#: Flags of symbols, by hash: however large the input is, they are so many.
FLAGS = 1 << 21


def _flagged(steps: DataFrame, front: DataFrame) -> DataFrame:
    """Steps of the symbols in front (id), and a few others."""
    flag = lambda c: F.xxhash64(c).bitwiseAND(F.lit(FLAGS - 1))
    return steps.join(F.broadcast(front.select(flag("id").alias("__flag")).distinct()), flag("at") == F.col("__flag"), "left_semi")


def _steps(edges: DataFrame, request: SliceRequest) -> DataFrame:
    """Edges as steps (at, to, confidence), the surest for each pair, that the request allows."""
    usable = edges.filter(F.col("confidence") >= request.min_confidence)
    if "type" in edges.columns:
        usable = usable.filter(F.col("type").isin(*request.edge_types))
    ways = {"out": ("caller", "callee"), "in": ("callee", "caller")}
    out = None
    for way, (at, to) in ways.items():
        if request.direction in (way, "both"):
            one = usable.select(F.col(at).cast("string").alias("at"), F.col(to).cast("string").alias("to"), F.col("confidence").cast("double").alias("confidence"))
            out = one if out is None else out.unionByName(one)
    return out.filter(F.col("at").isNotNull() & F.col("to").isNotNull()).groupBy("at", "to").agg(F.max("confidence").alias("confidence"))


def best_first_slices(edges: DataFrame, nodes: DataFrame, entries: DataFrame, request: SliceRequest) -> DataFrame:
    """entries (slice_id, id) to rows (slice_id, id, place, depth, score, kept): places count what is kept, from the entry's 0; spilled rows have none.

    edges (caller, callee, confidence, and type if only some are wanted), nodes (id, tokens, module). A symbol that nodes don't name costs nothing and has no module.
    Entries without edges are slices of one; repeated entries count once, null ones not at all.
    """
    w = WEIGHTS
    facts = nodes.groupBy(F.col("id").cast("string").alias("id")).agg(F.max("tokens").cast("long").alias("tokens"), F.min("module").alias("module"))
    fans = edges.filter(F.col("confidence") >= request.min_confidence).groupBy(F.col("callee").cast("string").alias("__fan")).agg(F.count("*").alias("fan_in"))
    steps = _steps(edges, request)
    known = steps.join(facts.withColumnRenamed("id", "__id"), F.col("to") == F.col("__id"), "left").join(fans, F.col("to") == F.col("__fan"), "left")
    tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    merit = w["confidence"] * F.col("confidence") + w["fan_in"] * F.log1p(F.coalesce("fan_in", F.lit(0))) + w["cost"] * tokens
    steps = materialise(known.select("at", "to", tokens.alias("tokens"), "module", merit.alias("merit")), "steps")
    #: The best that the steps of a symbol can score, but for proximity.
    reach = materialise(steps.groupBy("at").agg((F.max("merit") + w["novelty"]).alias("reach")), "reach")
    most = max(0, min(request.max_cards - 1, request.max_edges))
    state = entries.filter(F.col("id").isNotNull() & F.col("slice_id").isNotNull()).select(F.col("slice_id").cast("string").alias("slice_id"), F.col("id").cast("string").alias("id")).distinct()
    state = state.join(facts.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    modules = F.when(F.col("module").isNotNull(), F.array("module")).otherwise(F.array().cast("array<string>"))
    taken = materialise(state.select("slice_id", "id", F.lit(0).alias("place"), F.lit(0).alias("depth"), F.lit(None).cast("double").alias("score"), tokens.alias("spent"), modules.alias("modules")), "taken")
    done, front, pool = taken.select("slice_id", "id", "place", "depth", "score", F.lit(True).alias("kept")), taken, None
    slices_now = taken.select("slice_id", "spent", F.lit(0).alias("n"), "modules")
    while True:
        # what was taken last is expanded
        front = front.filter(F.col("depth") < request.depth).select("slice_id", "id", "depth", "modules")
        pushed = front.join(_flagged(steps, front), F.col("id") == F.col("at"))
        novel = F.when(F.col("module").isNotNull() & ~F.array_contains("modules", F.col("module")), w["novelty"]).otherwise(0.0)
        deeper = F.col("depth") + 1
        pushed = pushed.select("slice_id", F.col("to").alias("id"), deeper.alias("depth"), (F.col("merit") + w["proximity"] / deeper + novel).alias("score"), "tokens", "module")
        every = pushed if pool is None else pool.unionByName(pushed)
        # the best push of a symbol is the one that a queue pops first
        best = every.groupBy("slice_id", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "tokens", "module")).alias("b")).select("slice_id", "id", F.col("b.depth").alias("depth"), (-F.col("b.s")).alias("score"), "b.tokens", "b.module")
        gone = done.select(F.col("slice_id").alias("__s"), F.col("id").alias("__i"))
        pool = materialise(best.join(gone, (F.col("slice_id") == F.col("__s")) & (F.col("id") == F.col("__i")), "left_anti"), "pool")
        open_ = slices_now.filter(F.col("n") < most).select(F.col("slice_id").alias("__o"), "spent", "n", "modules")
        order = W.partitionBy("slice_id").orderBy(F.col("score").desc(), "id")
        top = pool.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= max(1, most))
        top = top.join(reach.withColumnRenamed("at", "__at"), F.col("id") == F.col("__at"), "left")
        brings = F.when(F.col("depth") < request.depth, F.col("reach") + w["proximity"] / (F.col("depth") + 1))
        before = F.max(brings).over(W.partitionBy("slice_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
        sure = top.withColumn("limit", before).withColumn("safe", F.col("limit").isNull() | (F.col("score") > F.col("limit")))
        sure = sure.withColumn("safe", F.min("safe").over(W.partitionBy("slice_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))).filter("safe")
        batch = sure.groupBy("slice_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "depth", "score", "tokens", "module"))).alias("batch")).join(open_, F.col("slice_id") == F.col("__o"))
        empty = F.array().cast("array<struct<id:string,place:int,depth:int,score:double,spent:bigint,modules:array<string>,kept:boolean>>")
        start = F.struct(F.col("spent").alias("spent"), F.col("n").alias("n"), F.col("modules").alias("modules"), empty.alias("out"))

        def take(acc, x):
            fits = (acc["spent"] + x["tokens"] <= request.max_tokens) & (acc["n"] < most)
            tried = acc["n"] < most
            seen = F.when(fits & x["module"].isNotNull(), F.array_union(acc["modules"], F.array(x["module"]))).otherwise(acc["modules"])
            n, spent = acc["n"] + fits.cast("int"), acc["spent"] + F.when(fits, x["tokens"]).otherwise(F.lit(0).cast("long"))
            row = F.struct(x["id"].alias("id"), F.when(fits, n).alias("place"), x["depth"].alias("depth"), x["score"].alias("score"), spent.alias("spent"), seen.alias("modules"), fits.alias("kept"))
            return F.struct(spent.alias("spent"), n.alias("n"), seen.alias("modules"), F.when(tried, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

        folded = materialise(batch.select("slice_id", F.aggregate("batch", start, take).alias("end")), "round")
        if not folded.limit(1).count():
            break
        rows = folded.select("slice_id", F.inline("end.out"))
        front = rows.filter("kept").select("slice_id", "id", "depth", "modules")
        done = materialise(done.unionByName(rows.select("slice_id", "id", "place", "depth", "score", "kept")), "done")
        ended = folded.select("slice_id", "end.spent", "end.n", "end.modules")
        slices_now = materialise(slices_now.join(ended.select("slice_id"), "slice_id", "left_anti").unionByName(ended), "slices")
    return done.unionByName(pool.select("slice_id", "id", F.lit(None).cast("int").alias("place"), "depth", "score", F.lit(False).alias("kept")))
