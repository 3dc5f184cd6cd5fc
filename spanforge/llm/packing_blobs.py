"""Blobs in which fragments of one bucket travel from a chunk of documents.

Equal fragments of a chunk are stored once; their places (row id, row key, offset) follow
column-wise and delta-coded, so a passage in a third of all documents costs its bytes once
a chunk and a few bytes a copy.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

BLOB_SCHEMA = "bucket long, body binary"


def put(frags: list[bytes], ids: np.ndarray, keys: np.ndarray, offsets: np.ndarray, extra: np.ndarray) -> bytes:
    """extra: one number a fragment (of distinct fragments, the first one's stays)."""
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(f, len(seen)) for f in frags), np.int64, len(frags))
    first = np.unique(which, return_index=True)[1]
    lengths = np.fromiter(map(len, seen), np.uint32, len(seen))
    delta = lambda a: np.diff(a, prepend=np.int64(0)).astype(np.int64).tobytes()
    raw = b"".join((lengths.tobytes(), extra[first].astype(np.uint32).tobytes(), np.diff(which, prepend=0).astype(np.int32).tobytes(), delta(ids), delta(keys), offsets.astype(np.uint32).tobytes(), *seen))
    return struct.pack("<II", len(seen), len(frags)) + zstandard.ZstdCompressor(level=3).compress(raw)


def get(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fragments, extra, which fragment each place holds, ids, keys, offsets)."""
    n, places = struct.unpack_from("<II", body)
    raw, at = zstandard.ZstdDecompressor().decompress(body[8:]), 0

    def take(kind, count):
        nonlocal at
        a = np.frombuffer(raw, kind, count, at)
        at += a.nbytes
        return a

    lengths, extra = take(np.uint32, n), take(np.uint32, n)
    which = np.cumsum(take(np.int32, places), dtype=np.int64)
    ids, keys = np.cumsum(take(np.int64, places)), np.cumsum(take(np.int64, places))
    offsets = take(np.uint32, places).astype(np.int64)
    ends = at + np.cumsum(lengths, dtype=np.int64)
    frags = [raw[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]
    return frags, extra, which, ids, keys, offsets


def by_bucket(buckets: np.ndarray):
    """(bucket, indices) of each bucket present."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part
