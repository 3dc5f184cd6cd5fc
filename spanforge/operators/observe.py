"""Requests end to end: the card at a position, the slice around it, definitions, matches.

requests (request_id, uri, line, column): 1-based line and character column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_offset, language_of
from ..sources.storage import materialise
from . import cards, slices
from .slices import SliceRequest


def _located(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with lang and the byte at their position (null: out of range)."""
    text = sources.select(F.col("uri").alias("__uri"), "text")
    j = requests.join(text, requests["uri"] == text["__uri"], "left").drop("__uri")
    at = byte_offset("text", F.col("line"), F.col("column"))
    return j.withColumn("lang", language_of("uri")).withColumn("at", at.cast("long")).drop("text")


def _asked(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """The sources that a request is about, with their language: no other file is parsed."""
    uris = requests.select(F.col("uri").alias("__asked")).distinct()
    return sources.join(uris, sources["uri"] == uris["__asked"], "left_semi").select("uri", language_of("uri").alias("lang"), "text")


def _entities(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """The entities of these sources, written, as several parts of an answer read them."""
    return materialise(cards.entities(_asked(sources, requests)), "entities")


def _entries(sources: DataFrame, requests: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id with the columns of the entity there, request_id with a refusal)."""
    located = _located(sources, requests)
    usable = located.filter("lang is not null and at is not null").select("request_id", "uri", "at")
    hit = cards.entity_at(usable, found).filter("name is not null")
    ids = hit.select(F.col("request_id").alias("__id")).distinct().withColumn("__hit", F.lit(True))
    j = located.join(ids, located["request_id"] == ids["__id"], "left")
    why = slices.refusal(F.coalesce("__hit", F.lit(False)), F.col("at").isNotNull(), F.col("lang"))
    return hit, j.select("request_id", why.alias("reason")).filter("reason is not null")


def get_card(sources: DataFrame, requests: DataFrame, detail: str = "structure") -> DataFrame:
    """request_id, status (success or refusal), reason, card."""
    found = _entities(sources, requests)
    hit, refused = _entries(sources, requests, found)
    card = cards.cards(hit.drop("at"), detail)
    keyed = hit.select("request_id", cards.symbol_id().alias("__symbol"))
    body = card.select(F.col("symbol.symbol_id").alias("__card"), F.struct(*card.columns).alias("card")).dropDuplicates(["__card"])
    ok = keyed.join(body, F.col("__symbol") == F.col("__card")).select("request_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("reason"), "card")
    return ok.unionByName(refused.select("request_id", F.lit("refusal").alias("status"), "reason"), allowMissingColumns=True)


def graph_slice(sources: DataFrame, requests: DataFrame, request: SliceRequest) -> DataFrame:
    """request_id, status, reason, cards, frontier, truncated: the entry and its siblings in the file, within the card budget.

    Siblings are the entities that the first non-blank lines of the file lie in.
    """
    found = _entities(sources, requests)
    hit, refused = _entries(sources, requests, found)
    lines = slices.discovery_lines(sources).select("uri", (F.col("line") - 1).alias("__line"), "capped")
    own = found.filter("kind <> 'Module'").withColumn("symbol_id", cards.symbol_id())
    seen = lines.withColumnRenamed("uri", "__uri")
    near = own.join(seen, (own["uri"] == seen["__uri"]) & F.col("__line").between(F.col("start_line"), F.col("end_line")), "left_semi")
    columns = ["symbol_id", "container", "name", "kind", "start_line", "start_column", "end_line", "end_column"]
    entries = hit.withColumn("symbol_id", cards.symbol_id()).select(F.col("request_id").alias("slice_id"), "uri", F.lit(True).alias("is_entry"), *columns)
    files = entries.select("slice_id", F.col("uri").alias("__file"))
    siblings = near.join(files, near["uri"] == files["__file"]).select("slice_id", "uri", F.lit(False).alias("is_entry"), *columns)
    rows = entries.unionByName(siblings).withColumn("kind", F.lower("kind"))
    caps = lines.groupBy(F.col("uri").alias("__u")).agg(F.max("capped").alias("__capped")).join(files, F.col("__u") == F.col("__file")).select(F.col("slice_id").alias("__slice"), "__capped")
    out = slices.slice_response(slices.apply_budget(rows, request.max_cards))
    out = out.join(caps, F.col("slice_id") == F.col("__slice"), "left").withColumn("truncated", F.col("truncated") | F.coalesce("__capped", F.lit(False)))
    out = out.select(F.col("slice_id").alias("request_id"), "status", F.lit(None).cast("string").alias("reason"), "cards", "frontier", "truncated")
    return out.unionByName(refused.select("request_id", F.lit("refusal").alias("status"), "reason"), allowMissingColumns=True)
