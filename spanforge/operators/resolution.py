"""Capability resolution: filter candidates, rank them, pick one, and explain every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Capabilities of language servers.
LSP_CAPABILITIES = ("definition", "references", "diagnostics", "call_hierarchy", "hover")


def lower_languages(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("languages", F.transform("languages", lambda x: F.lower(F.trim(x))))


def validate_manifests(manifests: DataFrame) -> DataFrame:
    """manifests with error: null, or why a manifest can't be registered."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    twice = F.count("*").over(W.partitionBy("name")) > 1
    error = F.when(blank("name"), "empty name").when(blank("version"), "empty version").when(F.coalesce(F.size("languages") < 1, F.lit(True)), "no languages").when(F.exists("languages", lambda x: F.trim(x) == ""), "blank language").when(~F.coalesce(F.col("executable").startswith("/"), F.lit(False)), "executable is not absolute").when(F.coalesce(F.col("timeout_secs") <= 0, F.lit(False)), "timeout is not positive").when(twice, "duplicate name")
    return lower_languages(manifests).withColumn("error", error)


def by(manifests: DataFrame, kind: str | None = None, language: str | None = None, capability: str | None = None) -> DataFrame:
    out = manifests
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if language is not None:
        out = out.filter(F.exists("languages", lambda x: F.lower(x) == language.strip().lower()))
    if capability is not None:
        out = out.filter(F.array_contains("capabilities", capability))
    return out


def resolve(manifests: DataFrame, requests: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """requests (request_id, capability, language, provider) to one row each with the choice and every candidate.

    language null: not supported; provider null: automatic. preferred (language, provider) ranks first.
    Columns: request_id, selection_mode, outcome, selected_provider, refusal_reason, candidates (by provider).
    """
    m = manifests.select(F.col("name").alias("__name"), "languages", F.explode(F.array_distinct("capabilities")).alias("__capability"))
    # names of all manifests tell an unknown provider from one without the capability
    known = manifests.select(F.col("name").alias("__known")).distinct()
    asked = requests.join(known, requests["provider"] == known["__known"], "left")
    pairs = asked.join(m, asked["capability"] == m["__capability"], "left")
    speaks = F.coalesce(F.exists("languages", lambda x: F.lower(x) == F.lower(F.col("language"))), F.lit(False))
    pairs = pairs.withColumn("__speaks", speaks)
    if preferred is not None:
        p = preferred.select(F.col("language").alias("__pl"), F.col("provider").alias("__pp"))
        pairs = pairs.join(p, (F.lower("language") == F.lower("__pl")) & (F.col("__name") == F.col("__pp")), "left").withColumn("__rank", F.when(F.col("__pp").isNotNull(), 0).otherwise(1)).drop("__pl", "__pp")
    else:
        pairs = pairs.withColumn("__rank", F.lit(1))
    explicit = F.col("provider").isNotNull()
    key = F.when(F.col("__speaks") & F.col("language").isNotNull(), F.struct("__rank", "__name"))
    best = F.min(key).over(W.partitionBy("request_id"))
    pairs = pairs.withColumn("__best", best["__name"])
    no_language = F.col("language").isNull()
    asked_for = F.col("__name") == F.col("provider")
    accepted = F.when(no_language, F.lit(False)).when(explicit, asked_for & F.col("__speaks")).otherwise(F.col("__name") == F.col("__best"))
    reason = (
        F.when(no_language, "unsupported_language")
        .when(explicit & ~asked_for, "not_requested")
        .when(explicit & F.col("__speaks"), "matched_language_and_capability")
        .when(explicit, "explicit_provider_mismatch")
        .when(~F.col("__speaks"), "unsupported_language")
        .when(F.col("__name") == F.col("__best"), "matched_language_and_capability")
        .otherwise("not_selected_by_policy")
    )
    candidate = F.when(F.col("__name").isNotNull(), F.struct(F.col("__name").alias("provider"), F.coalesce(accepted, F.lit(False)).alias("accepted"), reason.alias("reason")))
    out = pairs.groupBy("request_id", "language", "provider", "__known").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
    chosen = F.get(F.filter("candidates", lambda c: c["accepted"]), F.lit(0))["provider"]
    has = F.exists("candidates", lambda c: c["provider"] == F.col("provider"))
    refusal = (
        F.when(chosen.isNotNull(), F.lit(None).cast("string"))
        .when(no_language, "unsupported_language")
        .when(explicit & has, "explicit_provider_mismatch")
        .when(explicit & F.col("__known").isNotNull(), "provider_lacks_capability")
        .when(explicit, "provider_not_found")
        .otherwise("no_matching_provider")
    )
    return out.select("request_id", F.when(explicit, "explicit_provider").otherwise("automatic").alias("selection_mode"), F.when(chosen.isNotNull(), "selected").otherwise("refused").alias("outcome"), chosen.alias("selected_provider"), refusal.alias("refusal_reason"), "candidates")


def merge_capabilities(advertised: DataFrame, overrides: DataFrame) -> DataFrame:
    """advertised (language, capability, enabled), overrides (language, capability, directive) to enabled and its source.

    force beats deny beats what the server says; keys are trimmed and folded.
    """
    fold = lambda c: F.lower(F.trim(c))
    o = overrides.select(fold("language").alias("__l"), fold("capability").alias("__c"), fold("directive").alias("directive"))
    a = advertised.select(fold("language").alias("language"), fold("capability").alias("capability"), "enabled")
    j = a.join(o, (F.col("language") == F.col("__l")) & (F.col("capability") == F.col("__c")), "left")
    enabled = F.when(F.col("directive") == "force", F.lit(True)).when(F.col("directive") == "deny", F.lit(False)).otherwise(F.coalesce("enabled", F.lit(False)))
    source = F.when(F.col("directive") == "force", "forced").when(F.col("directive") == "deny", "denied").when(F.col("enabled"), "server").otherwise("missing")
    return j.select("language", "capability", enabled.alias("enabled"), source.alias("source"))


def compatible(a: str | Column, b: str | Column) -> Column:
    """Contract versions agree if their major numbers do."""
    return F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)
