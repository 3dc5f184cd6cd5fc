"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Each window has a minimiser: the
gram of GRAM words with the smallest hash in it (leftmost of equals), which depends on the
window's words alone. Consecutive windows with one minimiser travel as one packed string
to the bucket of that minimiser, so all copies of a window meet in one bucket and about
three words travel for each window instead of thirteen. In the bucket equal packed strings
are first collapsed; window hashes are sorted to find windows that occur again, and these
are compared byte by byte, so counts are exact.

Rules for odd input: null or wordless texts have no window; documents with a null id
neither remove nor lose words; rows with equal ids don't remove each other's words; very
long texts are cut into overlapping segments; an empty table gives an empty result. Only
doc_id and text are read; other columns pass through untouched.

Scale: a bucket holds about BUCKET_BYTES of packed strings, their number follows the
corpus. Copies within a chunk of CHUNK_BYTES collapse before the shuffle, so a passage in a
third of all documents sends one string a chunk and some four bytes a copy. What stands around
such a passage differs from copy to copy, though, and shares its minimiser: a first pass finds
these hot minimisers, and their windows travel one by one, dealt by a hash of the whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing_blobs, spans

WINDOW = 13
GRAM = 3
CHUNK_BYTES = 16 << 20
HASH_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
SEGMENT_WORDS = 100_000
_LOW = np.uint64((1 << 23) - 1)


def _super_kmers(raw: bytes, window: int, hot: np.ndarray):
    """Of segments of single-spaced words, one a line: (first byte, end byte, segment, first word in segment, bucket hash, fragment hash) arrays.

    The windows of a hot minimiser travel one by one, dealt by a hash of the whole window.
    """
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero((buf == 32) | (buf == 10))
    n = len(ends)
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    last = buf[ends] == 10
    segment = np.zeros(n, np.int64)
    segment[1:] = np.cumsum(last[:-1])
    prefix, inverse = common.prefix_hash(buf)
    hashed = lambda a, b: common.mix((prefix[b] - prefix[a]) * inverse[a])
    h = hashed(starts, ends)
    gram = min(GRAM, window)
    g = h[: n - gram + 1].copy()
    for k in range(1, gram):
        g = g * np.uint64(0x9FB21C651E98DF25) + h[k : n - gram + 1 + k]
    g = common.mix(g)
    key = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    low = common.sliding_min(key, window - gram + 1)
    ok = segment[: n - window + 1] == segment[window - 1 :]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-1]
    at = np.flatnonzero(ok & new)
    stop = np.ones(len(low), bool)
    stop[:-1] = new[1:] | ~ok[1:]
    end = np.flatnonzero(ok & stop)
    key = common.mix(low[at] >> np.uint64(23))
    if (some := spans.is_hot(key, hot)).any():
        alone = np.concatenate([np.arange(a, b + 1) for a, b in zip(at[some], end[some])])
        key = np.concatenate((key[~some], hashed(starts[alone], ends[alone + window - 1])))
        at, end = np.concatenate((at[~some], alone)), np.concatenate((end[~some], alone))
    base = np.searchsorted(segment, segment[at])
    s, e = starts[at], ends[end + window - 1]
    return s, e, segment[at], at - base, key, hashed(s, e)


def _segments(batches, window: int):
    """Lists of (bytes of a segment, doc id, row key, first word), about HASH_BYTES each."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), spans.texts(batch.column(2))):
            words = text.split()
            if doc is None or len(words) < window:
                continue
            for at in range(0, len(words) - window + 1, SEGMENT_WORDS):
                part = b" ".join(words[at : at + SEGMENT_WORDS + window - 1])
                held.append((part, doc, key, at))
                size += len(part)
                if size >= HASH_BYTES:
                    yield held, size
                    held, size = [], 0
    if held:
        yield held, size


def _lines(held: list[tuple]) -> bytes:
    return b"\n".join(x[0] for x in held) + b"\n"


def _hashes(batches, window: int):
    """(minimiser hash, fragment hash) of each chunk's super-k-mers."""
    ready: list[tuple] = []
    total = 0
    none = np.empty(0, np.uint64)
    for held, size in _segments(batches, window):
        ready.append(_super_kmers(_lines(held), window, none)[4:])
        total += size
        if total >= CHUNK_BYTES:
            yield tuple(map(np.concatenate, zip(*ready)))
            ready, total = [], 0
    if ready:
        yield tuple(map(np.concatenate, zip(*ready)))


def _pack(batches, buckets: int, window: int, hot: np.ndarray):
    ready: list[tuple] = []  # arrays of fragments
    total = 0

    def runs(held):
        raw = _lines(held)
        s, e, seg, word, h, _ = _super_kmers(raw, window, hot)
        ids, keys, base = (np.array([x[k] for x in held], np.int64) for k in (1, 2, 3))
        frags = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
        return frags, ids[seg], keys[seg], base[seg] + word, (h % np.uint64(buckets)).astype(np.int64)

    def flush():
        frags = [f for x in ready for f in x[0]]
        ids, keys, place, where = (np.concatenate([x[k] for x in ready]) for k in range(1, 5))
        zero = np.zeros(len(frags), np.uint32)
        out = [(bucket, packing_blobs.put([frags[k] for k in part.tolist()], ids[part], keys[part], place[part], zero[part])) for bucket, part in packing_blobs.by_bucket(where)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "body"])

    for held, size in _segments(batches, window):
        ready.append(runs(held))
        total += size
        if total >= CHUNK_BYTES:
            yield flush()
            ready, total = [], 0
    if ready:
        yield flush()


def _word_edges(frags: list[bytes]):
    """Of the joined fragments: bytes, word starts, word ends, first word of each fragment, words of each."""
    raw = b"\n".join(frags) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero((buf == 32) | (buf == 10))
    starts = np.empty(len(ends), np.int64)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    stop = np.flatnonzero(buf[ends] == 10) + 1
    first = np.append(0, stop[:-1])
    return raw, buf, starts, ends, first, stop - first


def _solve(bodies: list[bytes], window: int):
    """Spans (in words) of each document that windows with a smaller first document cover."""
    seen: dict[bytes, int] = {}
    least: list[int] = []
    most: list[int] = []
    parts = []
    for body in bodies:
        frags, _, which, ids, _, _ = packing_blobs.get(body)
        own = np.fromiter((seen.setdefault(f, len(seen)) for f in frags), np.int64, len(frags))
        least.extend([1 << 62] * (len(seen) - len(least)))
        most.extend([-(1 << 62)] * (len(seen) - len(most)))
        lo, hi = np.full(len(frags), 1 << 62, np.int64), np.full(len(frags), -(1 << 62), np.int64)
        np.minimum.at(lo, which, ids)
        np.maximum.at(hi, which, ids)
        for k, a, b in zip(own.tolist(), lo.tolist(), hi.tolist()):
            if a < least[k]:
                least[k] = a
            if b > most[k]:
                most[k] = b
        parts.append(own)
    frags = list(seen)
    lo, hi = np.array(least, np.int64), np.array(most, np.int64)
    hashes, owner, windows = [], [], np.array([f.count(b" ") + 2 - window for f in frags], np.int64)
    at = 0
    while at < len(frags):  # hash in pieces that stay in the processor's cache
        end, size = at, 0
        while end < len(frags) and size < 1 << 19:
            size += len(frags[end])
            end += 1
        _, buf, s, e, first, count = _word_edges(frags[at:end])
        w = count - window + 1
        k = np.repeat(first, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        hashes.append(common.range_hash(buf, s[k], e[k + window - 1]))
        at = end
    h = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(frags)), windows)
    index = np.arange(len(h)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    # exact: the windows of equal hash are told apart by their bytes
    first_doc = lo[owner].copy()
    todo = np.flatnonzero(again)
    table: dict[bytes, int] = {}
    texts = []
    cut, edges = -1, None
    for t in todo.tolist():
        f = int(owner[t])
        if f != cut:
            b = np.flatnonzero(np.frombuffer(frags[f] + b" ", np.uint8) == 32).tolist()
            edges, cut = ([0, *(x + 1 for x in b[:-1])], b), f
        k = int(index[t])
        x = frags[f][edges[0][k] : edges[1][k + window - 1]]
        texts.append(x)
        d = int(lo[f])
        if (y := table.get(x)) is None or d < y:
            table[x] = d
    first_doc[todo] = [table[x] for x in texts]
    start = np.cumsum(windows) - windows
    one_least, one_most = np.minimum.reduceat(first_doc, start), np.maximum.reduceat(first_doc, start)
    hit = one_least < hi  # fragments of which some copy loses words
    plain = one_least == one_most
    for body, own in zip(bodies, parts):
        if not hit[own].any():
            continue
        _, _, which, ids, keys, offsets = packing_blobs.get(body)
        u = own[which]
        whole = plain[u] & (one_least[u] < ids)
        a, b = offsets[whole], offsets[whole] + windows[u[whole]] + window - 1
        yield ids[whole], keys[whole], (a << 32) | b
        rest = np.flatnonzero(~plain[u] & (one_least[u] < ids))
        out = [[], [], []]
        for r in rest.tolist():
            k, d = u[r], ids[r]
            gone = np.flatnonzero(first_doc[start[k] : start[k] + windows[k]] < d)
            out[0] += [d] * len(gone)
            out[1] += [keys[r]] * len(gone)
            out[2] += (((offsets[r] + gone) << 32) | (offsets[r] + gone + window)).tolist()
        yield tuple(np.array(x, np.int64) for x in out)


def removed_word_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, __rk, span): word spans, start << 32 | end, covered by windows that start in a smaller doc_id too. docs needs __rk."""
    buckets = common.pieces(3 * common.text_bytes(docs), BUCKET_BYTES)
    hot = spans.hot_minimisers(docs, lambda it: _hashes(it, window))
    packed = spans.fragments(docs, lambda it, n: _pack(it, n, window, hot), buckets)
    return spans.find_spans(packed, lambda bodies: _solve(bodies, window), buckets)


def _digest(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column("doc_id").to_pylist(), spans.texts(batch.column("text")), spans.span_lists(spans.big(batch.column("__spans")))):
            words = text.split()
            n, kept = len(words), words
            if len(gone):
                keep = np.ones(n, bool)
                for a, b in zip(*common.merge_spans(gone)):
                    keep[a:b] = False
                kept = [words[k] for k in np.flatnonzero(keep)]
            rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with __spans, the word spans to remove."""
    keyed = spans.prepared(docs)
    return spans.join_spans(keyed, removed_word_spans(keyed, window))


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    joined = with_spans(docs.select("doc_id", "text"), window)
    return joined.select("doc_id", "text", "__spans").mapInArrow(lambda it: common.tidy(_digest(it)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words of the spans and the white space after them; what stays keeps its own white space."""
    buf = np.frombuffer(text, np.uint8)
    white = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = np.flatnonzero(~white & np.append(True, white[:-1]))
    edges = np.append(word, len(buf))
    keep = np.ones(len(buf), bool)
    for a, b in zip(*common.merge_spans(gone)):
        keep[edges[a] : edges[b]] = False
    return buf[keep].tobytes()


@common.keeping_columns
def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with removed words cut out of text (and n_chars, where there is one, brought up to date)."""
    names = docs.columns
    joined = with_spans(docs, window)

    @F.pandas_udf("string")
    def cut(text, gone):
        return text.combine(gone, lambda t, g: t if t is None or g is None or not len(g) else cut_words(t.encode(), np.asarray(g)).decode())

    touched = F.col("__spans").isNotNull()  # other texts don't go to Python
    out = joined.withColumn("text", F.when(touched, cut(F.when(touched, F.col("text")), "__spans")).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)
