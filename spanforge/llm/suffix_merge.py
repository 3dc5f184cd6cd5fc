"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Two occurrences of a LENGTH-byte string have equal bytes, hence the same minimiser (the
GRAM-byte substring with the smallest hash, leftmost of equals) at the same place. So every
run of windows with one minimiser travels as one fragment to the bucket of its minimiser,
and no match leaves its bucket. A fragment whose minimiser occurs nowhere else holds no
string that is elsewhere; all others are merged.

A shard is what a run of chunks of the corpus sent to the bucket; equal fragments are collapsed to
one with a count, in the first shard that holds it. Each shard's fragments are sorted by
themselves, without a byte of another shard, which gives the shard's Burrows-Wheeler transform over super-symbols of SYMBOL bytes, one
phase for each offset modulo SYMBOL. The transforms are merged by refining an interleave,
which holds only the shard of each merged place: every round reads each shard's transform in
its own order, deals the places to the symbols read, stably, and so extends the agreed prefix
by one symbol. No suffixes of different shards are ever compared. The round in which a
boundary first shows is the common prefix of the places on its sides; the intervals between
boundaries of fewer than LENGTH / SYMBOL rounds are the repeated intervals, and those whose
places stand for two or more occurrences mark what repeats.

What stands around a passage that very many documents share differs from copy to copy but shares
its minimiser; a first pass finds such hot minimisers, and their runs are cut and dealt by a longer substring too.

Rules for odd input: null text is empty; texts under LENGTH bytes lose nothing; matches
never cross documents; rows with equal ids are documents of their own; rows with a null id
take part like any other; very long texts are cut into overlapping segments; an empty table
gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing_blobs, spans

LENGTH = 200
GRAM = 32
SYMBOL = 8
CHUNK_BYTES = 16 << 20
HASH_BYTES = 1 << 18
BUCKET_BYTES = 16 << 20
SEGMENT_BYTES = HASH_BYTES
#: Bytes of the longer substring by which the windows of hot minimisers are dealt.
LONG_GRAM = 128
#: Bytes merged at once; their symbols then have 16-bit codes. The fragments of one minimiser that pass it are cut by a longer substring first.
MERGE_BYTES = 60_000
SHARDS = 4
_LOW = np.uint64((1 << 20) - 1)
#: Stands for a null id on the way.
_NO_ID = -(1 << 62)


def _minimiser_runs(raw: bytes, starts: np.ndarray, length: int, gram: int, hot: np.ndarray):
    """Of texts laid end to end (starts: of each, and the end): (text, first byte, end byte, gram's place in the fragment, bucket hash, fragment hash) of each run of windows.

    Runs of a hot minimiser are cut where the smallest LONG_GRAM-byte substring changes, and dealt by both.
    """
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    s, inverse = common.prefix_hash(buf)

    def smallest(size):
        g = common.mix((s[size:] - s[:-size]) * inverse[: n - size + 1])
        return common.sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - size + 1)

    low = smallest(gram)
    ok = text[: n - length + 1] == text[length - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    at = np.flatnonzero(ok & new)
    key = common.mix(low[at] >> np.uint64(20))
    if (some := spans.is_hot(key, hot)).any():
        every = np.zeros(len(low), bool)
        every[ok] = np.repeat(some, np.diff(np.append(np.flatnonzero((ok & new)[ok]), ok.sum())))
        long = smallest(min(LONG_GRAM, length))
        new[1:] |= every[1:] & (long[1:] != long[:-1])
        at = np.flatnonzero(ok & new)
        key = common.mix(low[at] >> np.uint64(20))
        key = np.where(every[at], common.mix(key ^ (long[at] >> np.uint64(20))), key)
    stop = np.ones(len(low), bool)
    stop[:-1] = new[1:] | ~ok[1:]
    end = np.flatnonzero(ok & stop) + length
    place = (low[at] & _LOW).astype(np.int64)
    return text[at], at, end, place - at, key, common.mix((s[end] - s[at]) * inverse[at])


def _segments(batches, length: int):
    """Lists of (bytes of a segment, doc id, row key, first byte), about HASH_BYTES each."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), spans.texts(batch.column(2))):
            for at in range(0, len(text) - length + 1, SEGMENT_BYTES):
                part = text[at : at + SEGMENT_BYTES + length - 1]
                held.append((part, doc, key, at))
                size += len(part)
                if size >= HASH_BYTES:
                    yield held, size
                    held, size = [], 0
    if held:
        yield held, size


def _laid(held: list[tuple]) -> tuple[bytes, np.ndarray]:
    return b"".join(x[0] for x in held), np.cumsum([0] + [len(x[0]) for x in held])


def _hashes(batches, length: int, gram: int):
    """(minimiser hash, fragment hash) of each chunk's runs."""
    ready: list[tuple] = []
    total = 0
    none = np.empty(0, np.uint64)
    for held, size in _segments(batches, length):
        ready.append(_minimiser_runs(*_laid(held), length, gram, none)[4:])
        total += size
        if total >= CHUNK_BYTES:
            yield tuple(map(np.concatenate, zip(*ready)))
            ready, total = [], 0
    if ready:
        yield tuple(map(np.concatenate, zip(*ready)))


def _pack(batches, buckets: int, length: int, gram: int, hot: np.ndarray):
    ready: list[tuple] = []  # arrays of fragments
    total = 0

    def runs(held):
        raw, starts = _laid(held)
        text, a, b, place, h, _ = _minimiser_runs(raw, starts, length, gram, hot)
        ids, keys, base = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
        frags = [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
        return frags, ids[text], keys[text], base[text] + a - starts[text], place, (h % np.uint64(buckets)).astype(np.int64)

    def flush():
        frags = [f for x in ready for f in x[0]]
        ids, keys, at, place, where = (np.concatenate([x[k] for x in ready]) for k in range(1, 6))
        out = [(bucket, packing_blobs.put([frags[k] for k in part.tolist()], ids[part], keys[part], at[part], place[part])) for bucket, part in packing_blobs.by_bucket(where)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "body"])

    for held, size in _segments(batches, length):
        ready.append(runs(held))
        total += size
        if total >= CHUNK_BYTES:
            yield flush()
            ready, total = [], 0
    if ready:
        yield flush()


def _stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order by linear-time passes over 16 bits each."""
    if x.dtype == np.uint16:
        return np.argsort(x, kind="stable")
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]


def _ranked(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from the order and the keys it sorts by."""
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.uint16 if keys[0].dtype == np.uint16 else np.int32)
    out[order] = np.cumsum(new)
    return out


class Shard(NamedTuple):
    alphabet: np.ndarray  # its super-symbols, ascending
    before: np.ndarray  # its transform: 1 + the place in the alphabet of the symbol before each suffix, in the shard's order (0: none)
    owner: np.ndarray  # the fragment of each suffix, in that order
    offset: np.ndarray  # and where it starts there


def transform(frags: list[bytes], length: int = LENGTH) -> Shard:
    """Suffix order (by length bytes at least) and transform of one shard, from its own fragments alone."""
    lens = np.array([len(f) for f in frags], np.int32)
    stride = lens + SYMBOL  # room for the SYMBOL ends of a fragment's phases
    start = (np.cumsum(stride) - stride).astype(np.int32)
    n = int(stride.sum())
    buf = np.frombuffer(b"".join(f + bytes(SYMBOL) for f in frags) + bytes(SYMBOL), np.uint8).astype(np.uint64)
    symbol = np.zeros(n, np.uint64)
    for k in range(SYMBOL):
        symbol = (symbol << np.uint64(8)) | buf[k : k + n]
    owner = np.repeat(np.arange(len(frags), dtype=np.int32), stride)
    offset = np.arange(n, dtype=np.int32) - start[owner]
    whole = offset <= lens[owner] - SYMBOL  # else the empty suffix that ends a phase
    alphabet, code = np.unique(symbol[whole], return_inverse=True)
    sym = np.zeros(n, np.uint16 if n < (1 << 16) - 1 else np.int32)  # ranks stay below n
    sym[whole] = code + 1
    rank, span = sym, SYMBOL
    follow = np.where(whole, np.arange(n, dtype=np.int32) + SYMBOL, n)
    while span < length:
        after = np.append(rank + 1, 0).astype(sym.dtype)[follow]
        order = _stable_order(after)
        order = order[_stable_order(rank[order])]
        rank = _ranked(order, rank, after)
        follow, span = np.append(follow, n)[follow], span * 2
    order = _stable_order(rank)
    before = np.where(offset >= SYMBOL, sym[np.arange(n) - SYMBOL], 0)[order]
    return Shard(alphabet, before.astype(sym.dtype), owner[order], offset[order])


def _by_shard(z: np.ndarray, shards: int) -> np.ndarray:
    """The places of each shard after those of the one before."""
    return np.concatenate([np.flatnonzero(z == s) for s in range(shards)])


def interleave(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merge: the shard of each place, and the symbols that it has in common with the place before (rounds: that many or more)."""
    alphabet = np.unique(np.concatenate([s.alphabet for s in shards]))  # a code of symbols for all shards, like that of bytes
    kind = np.uint16 if len(alphabet) < (1 << 16) - 1 else np.int32
    before = np.concatenate([np.append(0, 1 + np.searchsorted(alphabet, s.alphabet)).astype(kind)[s.before] for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.before) for s in shards])
    n = len(z)
    shared = np.full(n, rounds, np.uint16)
    shared[:1] = 0
    block = np.zeros(n, np.int32)
    read = np.empty(n, kind)
    new = np.zeros(n, bool)
    for turn in range(rounds):
        read[_by_shard(z, len(shards))] = before
        order = _stable_order(read)
        now, came = read.take(order), block.take(order)
        np.not_equal(now[1:], now[:-1], out=new[1:])
        new[1:] |= came[1:] != came[:-1]
        shared[new & (shared == rounds)] = turn
        z, block = z.take(order), new.cumsum(dtype=np.int32)
    return z, shared


def repeated_starts(frags: list[bytes], shard_of: list[int], length: int = LENGTH, copies: list[int] | None = None) -> list[np.ndarray]:
    """For each fragment, whether the length bytes from each of its windows' starts also start elsewhere among the fragments.

    copies: how often each fragment occurs.
    """
    shard = np.asarray(shard_of)
    members = [np.flatnonzero(shard == s) for s in np.unique(shard)]
    shards = [transform([frags[k] for k in part], length) for part in members]
    z, shared = interleave(shards, length // SYMBOL)
    # the interleave tells shard and turn of each place, hence the suffix
    owner = np.empty(len(z), np.int32)
    offset = np.empty(len(z), np.int32)
    turn = _by_shard(z, len(shards))
    owner[turn] = np.concatenate([part.astype(np.int32)[s.owner] for part, s in zip(members, shards)])
    offset[turn] = np.concatenate([s.offset for s in shards])
    interval = np.cumsum(shared < length // SYMBOL, dtype=np.int32)
    weight = np.ones(len(frags)) if copies is None else np.asarray(copies, np.float64)
    many = np.bincount(interval, weight[owner])[interval] > 1
    lens = np.array([len(f) for f in frags])
    starts = np.cumsum(lens) - lens
    flags = np.zeros(int(lens.sum()), bool)
    inside = offset < lens[owner]
    flags[starts[owner[inside]] + offset[inside]] = many[inside]
    return [flags[a : a + k - length + 1] for a, k in zip(starts.tolist(), lens.tolist())]


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Merges:
    """Collects fragments until they are worth a merge; found: runs of repeated starts of each entry (entry to (first, end) arrays)."""

    def __init__(self, length: int):
        self.length, self.size = length, 0
        self.held: list[tuple] = []
        self.found: dict[int, list] = {}

    def add(self, group: list[tuple]) -> None:
        """group: (bytes, shard, copies, entry, place of the first byte in the entry) of all fragments with one minimiser."""
        if sum(g[2] for g in group) < 2:
            return
        size = sum(len(g[0]) for g in group)
        if self.held and self.size + size > MERGE_BYTES:
            self.flush()
        self.held += group
        self.size += size
        if self.size >= MERGE_BYTES:
            self.flush()

    def flush(self) -> None:
        held, self.held, self.size = self.held, [], 0
        if held:
            flags = repeated_starts([h[0] for h in held], [h[1] for h in held], self.length, [h[2] for h in held])
            for (_, _, _, entry, at), f in zip(held, flags):
                if f.any():
                    a, b = _runs_of(f)
                    self.found.setdefault(entry, []).append((a + at, b + at))


def _cut(group: list[tuple], length: int) -> Iterator[list[tuple]]:
    """The fragments of a minimiser that has very many, by the smallest LONG_GRAM-byte substring of their windows."""
    raw = b"".join(g[0] for g in group)
    starts = np.cumsum([0] + [len(g[0]) for g in group])
    text, a, b, _, key, _ = _minimiser_runs(raw, starts, length, min(LONG_GRAM, length), np.empty(0, np.uint64))
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order].view(np.int64))) + 1):
        yield [(raw[a[k] : b[k]], *group[text[k]][1:4], int(a[k] - starts[text[k]])) for k in part.tolist()]


def _solve(bodies: list[bytes], length: int, gram: int):
    copies: list[int] = []
    anchors: dict[bytes, list[tuple[int, bytes]]] = {}
    shard_of: list[int] = []
    seen: dict[bytes, int] = {}
    parts = []
    for turn, body in enumerate(bodies):
        frags, place, which, *_ = packing_blobs.get(body)
        own = []
        for f, p, c in zip(frags, place.tolist(), np.bincount(which, minlength=len(frags)).tolist()):
            if (k := seen.get(f)) is None:
                k = seen[f] = len(copies)
                copies.append(0)
                shard_of.append(turn * SHARDS // len(bodies))
                anchors.setdefault(f[p : p + gram], []).append((k, f))
            copies[k] += c
            own.append(k)
        parts.append(np.array(own, np.int64))
    merges = _Merges(length)
    while anchors:
        _, members = anchors.popitem()
        if len(members) == 1 and copies[members[0][0]] == 1:
            continue
        group = [(f, shard_of[k], copies[k], k, 0) for k, f in members]
        if len(group) > 1 and sum(len(g[0]) for g in group) > MERGE_BYTES:
            for part in _cut(group, length):
                merges.add(part)
        else:
            merges.add(group)
    merges.flush()
    # the runs of all entries one after another
    runs = [(k, a, b) for k, found in merges.found.items() for a, b in found]
    entry = np.repeat(np.array([k for k, _, _ in runs], np.int64), [len(a) for _, a, _ in runs])
    first, end = (np.concatenate([r[c] for r in runs]) if runs else np.empty(0, np.int64) for c in (1, 2))
    order = np.argsort(entry, kind="stable")
    first, end = first[order], end[order] - 1 + length
    count = np.bincount(entry, minlength=len(copies))
    start = np.cumsum(count) - count
    for body, own in zip(bodies, parts):
        _, _, which, ids, keys, offsets = packing_blobs.get(body)
        u = own[which]
        n = count[u]
        row = np.repeat(np.arange(len(u)), n)
        at = start[u[row]] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        yield ids[row], keys[row], ((offsets[row] + first[at]) << 32) | (offsets[row] + end[at])


def _digest(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column("doc_id").to_pylist(), spans.texts(batch.column("text")), spans.span_lists(spans.big(batch.column("__spans")))):
            kept, removed, runs = text, 0, 0
            if len(gone):
                a, b = common.merge_spans(gone)
                edges = np.concatenate(([0], np.column_stack((a, b)).ravel(), [len(text)])).tolist()
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                removed, runs = len(text) - len(kept), len(a)
            rows.append((doc, len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_byte_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, __rk, span): byte spans, start << 32 | end, covered by strings of length bytes that start anywhere else too. docs needs doc_id (a row's number), __rk and text."""
    if length % SYMBOL or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {SYMBOL} and at least {2 * GRAM}")
    buckets = common.pieces(4 * common.text_bytes(docs), BUCKET_BYTES)
    hot = spans.hot_minimisers(docs, lambda it: _hashes(it, length, GRAM))
    packed = spans.fragments(docs, lambda it, n: _pack(it, n, length, GRAM, hot), buckets)
    return spans.find_spans(packed, lambda bodies: _solve(bodies, length, GRAM), buckets)


def suffix_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Spans are joined back by id and, where ids repeat or are null, by a hash of the text: rows that
    share both have equal texts, so they lose the same bytes.
    """
    keyed = spans.prepared(docs.select("doc_id", "text"))
    numbered = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    joined = spans.join_spans(numbered, repeated_byte_spans(numbered, length))
    joined = joined.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
    return joined.select("doc_id", "text", "__spans").mapInArrow(lambda it: common.tidy(_digest(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
