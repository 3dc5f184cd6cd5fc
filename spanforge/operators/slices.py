"""Budgeted graph slices: argument checks, discovery, stable order, limit, spillover."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import materialise

# Defaults and limits of a slice.
MAX_CARDS, MAX_EDGES, MAX_TOKENS, DEPTH, MIN_CONFIDENCE, DISCOVERY = 30, 200, 4000, 2, 0.5, 256
EDGE_TYPES = ("call", "import", "config")
DIRECTIONS = ("in", "out", "both")
DETAIL = ("minimal", "signature", "structure", "semantic", "full")
KIND_RANK = ("function", "method", "class", "interface", "type", "variable", "module", "field")
REFUSALS = ("no_symbol_at_position", "position_out_of_range", "unsupported_language", "not_yet_implemented", "backend_unavailable")


@dataclass(frozen=True)
class SliceRequest:
    uri: str
    line: int
    column: int
    depth: int = DEPTH
    direction: str = "both"
    edge_types: tuple[str, ...] = EDGE_TYPES
    min_confidence: float = MIN_CONFIDENCE
    max_cards: int = MAX_CARDS
    max_edges: int = MAX_EDGES
    max_tokens: int = MAX_TOKENS
    entry_detail: str = "structure"
    node_detail: str = "minimal"
    extra: dict = field(default_factory=dict)


_FLAGS = {"--uri": "uri", "--position": "position", "--depth": "depth", "--direction": "direction", "--edge-types": "edge_types", "--min-confidence": "min_confidence", "--max-cards": "max_cards", "--max-edges": "max_edges", "--max-estimated-tokens": "max_tokens", "--entry-detail": "entry_detail", "--node-detail": "node_detail"}


def parse_position(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d+):(\d+)", text)
    if not m or not all(1 <= int(x) < 1 << 32 for x in m.groups()):
        raise ValueError(f"position must be LINE:COL from 1, got {text!r}")
    return int(m[1]), int(m[2])


def parse_request(arguments: list[str]) -> SliceRequest:
    """Rejects unknown flags, values out of range and URIs other than file://."""
    values: dict = {}
    it = iter(arguments)
    for flag in it:
        if flag not in _FLAGS:
            raise ValueError(f"unknown flag {flag}")
        value = next(it, None)
        if value is None:
            raise ValueError(f"{flag} needs a value")
        values[_FLAGS[flag]] = value
    if not values.get("uri", "").startswith("file://"):
        raise ValueError("--uri must begin with file://")
    if "position" not in values:
        raise ValueError("--position is required")
    line, column = parse_position(values.pop("position"))
    for key in ("depth", "max_cards", "max_edges", "max_tokens"):
        if key in values:
            values[key] = int(values[key])
            if values[key] < (0 if key == "depth" else 1):
                raise ValueError(f"{key} out of range")
    if "min_confidence" in values:
        values["min_confidence"] = float(values["min_confidence"])
        if not 0 <= values["min_confidence"] <= 1:
            raise ValueError("confidence must be from 0 to 1")
    if "edge_types" in values:
        values["edge_types"] = normalise_edge_types([x.strip() for x in values["edge_types"].split(",")])
    for key, known in (("direction", DIRECTIONS), ("entry_detail", DETAIL), ("node_detail", DETAIL)):
        if key in values and values[key] not in known:
            raise ValueError(f"unknown {key} {values[key]!r}")
    return SliceRequest(line=line, column=column, **values)


def normalise_edge_types(types: list[str]) -> tuple[str, ...]:
    if bad := [t for t in types if t not in EDGE_TYPES]:
        raise ValueError(f"unknown edge type {bad[0]!r}")
    return tuple(sorted(set(types), key=EDGE_TYPES.index))


def rank(value: str | Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(value) if isinstance(value, str) else value)


def filter_edges(edges: DataFrame, request: SliceRequest) -> DataFrame:
    """Edges (type, confidence, direction) that a request asks for."""
    out = edges.filter(F.col("type").isin(*request.edge_types) & (F.col("confidence") >= request.min_confidence))
    return out if request.direction == "both" else out.filter(F.col("direction") == request.direction)


def discovery_lines(sources: DataFrame, most: int = DISCOVERY) -> DataFrame:
    """(uri, line, capped): the first non-blank lines of each file, 1-based, and whether there were more."""
    rows = sources.select("uri", F.posexplode(F.split("text", "\n")).alias("at", "line_text")).filter(F.trim("line_text") != "")
    rows = rows.withColumn("__rn", F.row_number().over(W.partitionBy("uri").orderBy("at")))
    some = rows.filter(F.col("__rn") <= most + 1).withColumn("capped", F.max(F.col("__rn") > most).over(W.partitionBy("uri")))
    return some.filter(F.col("__rn") <= most).select("uri", (F.col("at") + 1).alias("line"), "capped")


def stable_order() -> list[Column]:
    return [F.coalesce("container", F.lit("")), F.col("name"), rank("kind", KIND_RANK), F.col("start_line"), F.col("start_column"), F.col("end_line"), F.col("end_column")]


def apply_budget(cards: DataFrame, max_cards: int = MAX_CARDS, group: str = "slice_id") -> DataFrame:
    """cards (group, symbol_id, is_entry, container, name, kind, range) with place and kept.

    One card for each symbol, the earliest; the entry first, then siblings in stable order, as many as
    the budget holds; the others are the frontier at depth 1.
    """
    first = W.partitionBy(group, "symbol_id").orderBy(F.col("is_entry").desc(), "start_line", "start_column")
    once = cards.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    order = W.partitionBy(group).orderBy(F.col("is_entry").desc(), *stable_order(), "symbol_id")
    return once.withColumn("place", F.row_number().over(order)).withColumn("kept", F.col("place") <= max_cards)


def slice_response(budgeted: DataFrame, capped: Column | None = None, group: str = "slice_id") -> DataFrame:
    """One row for each slice: cards, spillover (frontier, truncated), status."""
    card = F.struct("place", "symbol_id", "name", "kind")
    out = budgeted.groupBy(group).agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), card))).alias("cards"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct("place", "symbol_id", F.lit(1).alias("depth"))))).alias("frontier"),
    )
    truncated = (F.size("frontier") > 0) | (capped if capped is not None else F.lit(False))
    return out.select(group, F.lit("success").alias("status"), "cards", "frontier", truncated.alias("truncated"))


def refusal(has_symbol: Column, in_range: Column, language: Column) -> Column:
    """The refusal reason of a request, or null."""
    return F.when(language.isNull(), REFUSALS[2]).when(~in_range, REFUSALS[1]).when(~has_symbol, REFUSALS[0])


# Weights of a node's score in a multi-hop slice.
SCORE_WEIGHTS = {"confidence": 1.0, "fan_in": 0.3, "proximity": 0.5, "cost": -0.001}


def priority_slice(edges: DataFrame, costs: DataFrame, entry: str, request: SliceRequest) -> DataFrame:
    """Multi-hop slice: (id, depth, score, kept) from an entry symbol, best score first, within depth, cards, edges and tokens.

    edges (caller, callee, confidence, and type, if edges of some types only are wanted), costs (id, tokens). One bounded join for each
    hop; a node keeps the depth at which it is first seen. A hop goes on from its best max_cards nodes at most, and from
    no more than max_edges leaves; all other nodes that it reaches are spillover: rows that aren't kept.
    """
    spark = edges.sparkSession
    usable = edges.filter(F.col("confidence") >= request.min_confidence)
    if "type" in edges.columns:
        usable = usable.filter(F.col("type").isin(*request.edge_types))
    fans = usable.groupBy("callee").agg(F.count("*").alias("fan_in")).withColumnRenamed("callee", "__fan")
    ends = []
    if request.direction in ("out", "both"):
        ends.append(usable.select(F.col("caller").alias("__at"), F.col("callee").alias("id"), "confidence"))
    if request.direction in ("in", "both"):
        ends.append(usable.select(F.col("callee").alias("__at"), F.col("caller").alias("id"), "confidence"))
    steps = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    seen = {entry: (0, float("inf"))}  # at most depth * max_cards ids
    front, spills, left = [entry], None, request.max_edges
    for depth in range(1, request.depth + 1):
        at = spark.createDataFrame([(x,) for x in front], "__from string")
        found = steps.join(F.broadcast(at), steps["__at"].cast("string") == at["__from"]).groupBy("id").agg(F.max("confidence").alias("confidence"))
        found = found.join(fans, found["id"] == fans["__fan"], "left")
        w = SCORE_WEIGHTS
        tokens = costs.select(F.col("id").alias("__cost"), "tokens")
        found = found.join(tokens, found["id"] == tokens["__cost"], "left")
        score = w["confidence"] * F.col("confidence") + w["fan_in"] * F.log1p(F.coalesce("fan_in", F.lit(0))) + w["proximity"] / depth + w["cost"] * F.coalesce("tokens", F.lit(0))
        new = found.filter(~F.col("id").cast("string").isin(list(seen)))
        new = materialise(new.select(F.col("id").cast("string").alias("id"), F.lit(depth).alias("depth"), score.alias("score")), "reached")
        rows = new.orderBy(F.desc("score"), "id").limit(max(0, min(request.max_cards, left))).collect()
        front = [r["id"] for r in rows]
        seen |= {r["id"]: (depth, r["score"]) for r in rows}
        left -= len(front)
        spills = new if spills is None else spills.unionByName(new)
        if not front:
            break
    out = spark.createDataFrame([(k, d, s) for k, (d, s) in seen.items()], "id string, depth int, score double")
    spent = costs.select(F.col("id").cast("string").alias("__id"), "tokens")
    out = out.join(spent, out["id"] == spent["__id"], "left").drop("__id")
    order = W.orderBy(F.desc("score"), "depth", "id")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = (F.row_number().over(order) <= request.max_cards) & ((total <= request.max_tokens) | (F.col("id") == entry))
    out = out.withColumn("kept", kept).select("id", "depth", "score", "kept")
    if spills is None:
        return out
    first = spills.filter(~F.col("id").isin(list(seen))).groupBy("id").agg(F.min_by(F.struct("depth", "score"), "depth").alias("f"))
    return out.unionByName(first.select("id", "f.depth", "f.score", F.lit(False).alias("kept")))
