"""Structured Streaming facades: requests, document versions, revision caches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import parse_requests, responses


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that arrive in a folder, parsed and checked."""
    return parse_requests(spark.readStream.text(folder))


def serve(requests: DataFrame, handlers: dict[tuple[str, str], Callable[[DataFrame], DataFrame]], checkpoint: str, sink: str):
    """Runs each batch's requests by their (domain, operation) and appends a stream line and an exit line for each to sink; unhandled ones are answered as not implemented."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        out = df.filter(F.col("error").isNotNull()).select("domain", "operation", F.col("error").alias("data"), F.lit(1).alias("status"))
        known = F.lit(False)
        for (domain, operation), handle in handlers.items():
            mine = (F.col("domain") == domain) & (F.col("operation") == operation)
            known = known | mine
            out = out.unionByName(handle(df.filter(F.col("error").isNull() & mine)).select("domain", "operation", "data", "status"))
        rest = df.filter(F.col("error").isNull() & ~known)
        out = out.unionByName(rest.select("domain", "operation", F.lit("not yet implemented").alias("data"), F.lit(1).alias("status")))
        numbered = out.select(F.monotonically_increasing_id().alias("answer"), "data", "status")
        lines = responses(numbered).sortWithinPartitions("answer", "ord")  # an answer's lines stay in one partition, one after the other
        lines.select("value").write.mode("append").text(sink)
        df.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


_KINDS = ("open", "change", "close")


def _turn():
    return F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind"))


def document_changes(events: DataFrame, late: str = "7 days", keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of document events (uri, version, kind, text, ts) to what becomes of each document: uri, version, open, text (null: closed), a row whenever that changes.

    The last event of a document, by version, is held as state, so events that come late, twice or out of order change nothing, a change after its
    close included; at one version a close comes last. Events more than late behind the newest are dropped; a document is forgotten once the
    watermark is keep_ms past its last event's batch, and a later event begins it anew. Events without uri or version are dropped.
    """

    def follow(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rank = lambda e: (e[0], e[1], e[2] is not None, e[2] or "")
        held = tuple(state.get) if state.exists else None
        best = held
        for frame in frames:
            for version, turn, text in zip(frame["version"], frame["turn"], frame["text"]):
                event = (int(version), int(turn), None if pd.isna(text) else str(text))
                if best is None or rank(event) > rank(best):
                    best = event
        state.update(best)
        state.setTimeoutTimestamp(max(0, state.getCurrentWatermarkMs()) + keep_ms)
        if best != held:
            version, turn, text = best
            yield pd.DataFrame({"uri": [key[0]], "version": [version], "open": [turn != 3], "text": pd.Series([None if turn == 3 else text], dtype=object)})

    rows = events.filter("uri is not null and version is not null").select("uri", F.col("version").cast("long").alias("version"), _turn().cast("int").alias("turn"), "text", "ts").withWatermark("ts", late)
    return rows.groupBy("uri").applyInPandasWithState(follow, "uri string, version long, open boolean, text string", "version long, turn int, text string", "update", "EventTimeTimeout")


def open_documents(changes: DataFrame) -> DataFrame:
    """The documents that are open after all changes (uri, version, open, text): what latest_documents gives for the events."""
    last = changes.groupBy("uri").agg(F.max(F.struct("version", (~F.col("open")).alias("closed"), "text")).alias("last"))
    return last.filter("not last.closed").select("uri", "last.version", "last.text")


def latest_documents(events: DataFrame) -> DataFrame:
    """Document events (uri, version, kind: open, change or close, text) to each open document's last text; batch or streaming (update mode)."""
    turn = _turn().alias("turn")  # at one version a close comes last
    last = events.groupBy("uri").agg(F.max(F.struct("version", turn, "text")).alias("last"))
    return last.filter("last.turn <> 3").select("uri", "last.version", "last.text")


def fresh_revisions(sources: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """sources (uri, content_hash, ts, ...): each revision of a file once within the watermark, the streaming form of a revision-keyed cache."""
    if sources.isStreaming:
        return sources.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["uri", "content_hash"])
    return sources.dropDuplicates(["uri", "content_hash"])
