"""Language-server responses as a source: recorded JSON responses instead of a live server.

Definitions come as one location, a list, or links; all become 1-based rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POSITION = "struct<line:long,character:long>"
_RANGE = f"struct<start:{_POSITION},end:{_POSITION}>"


def read_responses(spark: SparkSession, *paths: str) -> DataFrame:
    """Recorded responses, a JSON object a line, from any storage Spark reads: request_id, method, result (its JSON text)."""
    line = F.parse_json("value")
    field_of = lambda name: F.try_variant_get(line, f"$.{name}", "string")
    result = F.coalesce(F.to_json(F.try_variant_get(line, "$.result", "variant")), F.lit("null"))
    return spark.read.text(list(paths)).filter(F.trim("value") != "").select(field_of("request_id").alias("request_id"), field_of("method").alias("method"), result.alias("result"))


def definitions(responses: DataFrame) -> DataFrame:
    """definition responses to (request_id, ord, uri, line, column), 1-based."""
    location = f"struct<uri:string,range:{_RANGE},targetUri:string,targetSelectionRange:{_RANGE}>"
    text = F.when(F.trim("result").startswith("["), F.col("result")).otherwise(F.concat(F.lit("["), "result", F.lit("]")))
    rows = responses.filter("method = 'definition' and result <> 'null'").select("request_id", F.posexplode(F.from_json(text, f"array<{location}>")).alias("ord", "l"))
    start = F.coalesce("l.range.start", "l.targetSelectionRange.start")
    return rows.select("request_id", "ord", F.coalesce("l.uri", "l.targetUri").alias("uri"), (start["line"] + 1).alias("line"), (start["character"] + 1).alias("column"))


def group_locations(locations: DataFrame) -> DataFrame:
    """(request_id, ord, uri, line, column) to one row a file, files in the order they are first seen."""
    grouped = locations.groupBy("request_id", "uri").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "line", "column"))).alias("at"))
    return grouped.withColumn("at", F.transform("at", lambda x: F.struct(x["line"].alias("line"), x["column"].alias("column"))))


def enrich_with_hover(cards: DataFrame, hovers: DataFrame) -> DataFrame:
    """cards (symbol_id, provenance array, ...) and hovers (symbol_id, text): adds lsp, and swaps the provenance marker; cards without a hover stay."""
    h = hovers.select(F.col("symbol_id").alias("__id"), F.col("text").alias("__hover"))
    j = cards.join(h, F.col("symbol_id") == F.col("__id"), "left")
    lines = F.transform(F.split("__hover", "\n"), lambda x: F.trim(x))
    kind = F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("```")), F.lit(0))
    lsp = F.when(F.col("__hover").isNotNull(), F.struct(F.col("__hover").alias("hover"), kind.alias("type"), F.lower("__hover").contains("deprecated").alias("deprecated")))
    provenance = F.when(F.col("__hover").isNotNull(), F.array_append(F.array_remove("provenance", "tree_sitter_degraded_semantic"), "lsp_hover")).otherwise(F.col("provenance"))
    return j.withColumn("lsp", lsp).withColumn("provenance", provenance).drop("__id", "__hover")
