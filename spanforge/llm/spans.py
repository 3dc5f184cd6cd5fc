"""The frame that substring operators share: deal fragments to buckets, find spans, join them back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing_blobs

SPAN_SCHEMA = "doc_id long, __rk long, span long"


def fragments(docs: DataFrame, pack: Callable, buckets: int) -> DataFrame:
    """docs (doc_id, __rk, text) to one row for each chunk of documents and bucket."""
    return docs.select("doc_id", "__rk", "text").mapInArrow(lambda it: common.tidy(pack(it, buckets)), packing_blobs.BLOB_SCHEMA)


#: A minimiser with this many distinct fragments is hot: its windows are dealt by a second key.
HOT_FRAGMENTS = 20_000
#: Hot minimisers known to the tasks, the most frequent first (8 bytes each).
MOST_HOT = 100_000
#: Distinct fragments in a chunk from which a task reports a minimiser's count; of those with fewer it reports one fragment in THIN, chosen by hash, as THIN.
REPORTED = 4
THIN = 64
#: Tasks that solve buckets; with more buckets a task solves one after another.
MOST_PARTITIONS = 50_000


def hot_minimisers(docs: DataFrame, runs: Callable) -> np.ndarray:
    """Sorted hashes of minimisers that many different fragments share, such as those of a line in a third of all documents.

    runs: batches to (minimiser hash, fragment hash) arrays of a chunk each. Equal fragments of a chunk count
    once, as they travel once. A minimiser that no chunk sees often is found by the share of its fragments that is reported.
    The counts decide how windows are dealt, never what is found.
    """

    def report(batches):
        for minimiser, fragment in runs(batches):
            if not len(minimiser):
                continue
            order = np.lexsort((fragment, minimiser))
            m, f = minimiser[order], fragment[order]
            new = np.append(True, (m[1:] != m[:-1]) | (f[1:] != f[:-1]))
            keys, counts = np.unique(m[new], return_counts=True)
            some = counts >= REPORTED
            thin = m[new][np.repeat(~some, counts) & (f[new] % np.uint64(THIN) == 0)]
            both = np.concatenate((keys[some], thin)), np.concatenate((counts[some], np.full(len(thin), THIN)))
            yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1])], names=["h", "n"])

    counts = docs.select("doc_id", "__rk", "text").mapInArrow(lambda it: common.tidy(report(it)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") >= HOT_FRAGMENTS).orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()
    return np.sort(np.array([r["h"] for r in hot], np.int64).view(np.uint64))


def is_hot(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(hashes), bool)
    return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes


def bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The bodies of one bucket after another, from rows sorted by bucket."""
    now, bodies = None, []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and bodies:
                yield bodies
                bodies = []
            now = bucket
            bodies.append(body)
    if bodies:
        yield bodies


def find_spans(packed: DataFrame, solve: Callable[[list[bytes]], Iterator[tuple]], buckets: int) -> DataFrame:
    """solve: bodies of one bucket to (ids, keys, packed spans) arrays; a row for each span."""

    def run(batches):
        for bodies in bucket_groups(batches):
            for ids, keys, span in solve(bodies):
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(span)], names=["doc_id", "__rk", "span"])

    dealt = packed.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: common.tidy(run(it)), SPAN_SCHEMA)


def join_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its list of spans (null: none). A list is bounded by its document."""
    per_row = spans.groupBy("doc_id", "__rk").agg(F.collect_list("span").alias("__spans"))
    per_row = per_row.withColumnsRenamed({"doc_id": "__id", "__rk": "__key"})
    on = (docs["doc_id"] == per_row["__id"]) & (docs["__rk"] == per_row["__key"])
    return docs.join(per_row, on, "left").drop("__id", "__key")


def span_lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    for x in column:
        body = x.as_buffer()  # no copy of the column
        yield body.to_pybytes() if body is not None else b""


def big(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def prepared(docs: DataFrame) -> DataFrame:
    return common.with_row_key(docs)
