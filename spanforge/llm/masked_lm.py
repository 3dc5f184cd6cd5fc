"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

The vocabulary is every word that occurs at least 1/OFTEN times the root of the corpus's
words, so it grows with about that root, and is the VOCAB most frequent words where those are more. Other words go to
hashed buckets, whose number grows with the vocabulary; such a word's probability is its bucket's times its share
of the bucket in the corpus, by the counts of all words (a word never counted: as if once). The network sees SIDE words on each side of a masked word, embeds them by
position, and predicts the masked id in two steps, class and member of the class, each a
softmax over about the root of the vocabulary. A document's score is the sum of the
conditional log-probabilities of all its words, each masked in turn.

The words of all texts are looked up once; their ids, two or four bytes a word, are a table that training and scoring
read. Training covers every word: the rounds share out the residues, so that each is trained on (more than MASK rounds
begin anew). In each round every shard starts from the round's
weights, makes one pass over its texts with some residues of the positions modulo MASK masked, and returns its weights. Shards are
dealt and ordered by a hash of id and text and their number follows from the count of words, so the result doesn't depend on
how the input is partitioned. The average of their weights, weighted by masked positions, is formed by a
grouped sum over blocks of parameters; the driver only sees the average and the vocabulary, which grow with the
root of the corpus, and so do the shards. Word counts travel in packed buckets. Counts of the words outside the vocabulary stay a table: a slice of texts asks for those of its
distinct words by 64-bit hash, a bucket of hashes at a time, and adds up the answers for each text.

Rules for odd input: null or wordless texts score 0 with mean null; rows with equal ids
are scored one by one; very long texts are taken in pieces of PIECE words with their
context; an empty table gives an empty result. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packing_blobs

#: The least sizes, as of a small corpus.
VOCAB = 2175
BUCKETS = 128
CLASS = 48
#: A word of the vocabulary occurs at least isqrt(words of the corpus) // OFTEN times; it has so many words for each bucket.
OFTEN = 8
SPREAD = 16
DIM = 32
SIDE = 2
MASK = 8
ROUNDS = 2
BATCH = 1024
TRAIN_BATCH = 1024
#: Words of a shard: this many at least, and SHARD_ROOTS times the root of the corpus's words.
SHARD_WORDS = 1 << 22
SHARD_ROOTS = 64
RATE = 0.1
PIECE = 200_000
BLOCK = 4096
#: Text looked up at once; counts held before they go out; distinct words of a bucket of counts.
SLICE_BYTES = 16 << 20
HELD_COUNTS = 2_000_000
#: Buckets in which counts of words meet.
COUNT_BUCKETS = 256
BUCKET_WORDS = 1 << 20

#: Ids: 0 stands for no word (before the first and after the last), then the vocabulary, then hashed ids.
SIZE = 1 + VOCAB + BUCKETS
SIZES = (VOCAB, BUCKETS)


def sizes_for(vocab: int) -> tuple[int, int]:
    """Words of the vocabulary and buckets."""
    vocab = max(VOCAB, vocab)
    return vocab, max(BUCKETS, vocab // SPREAD)


def shapes(sizes: tuple[int, int]) -> dict[str, tuple]:
    size = 1 + sum(sizes)
    members = max(CLASS, math.isqrt(size - 1) + 1)
    classes = -(-size // members)
    return {"embed": (2 * SIDE, size, DIM), "bias": (DIM,), "to_class": (DIM, classes), "class_bias": (classes,), "class_embed": (classes, DIM), "to_member": (DIM, members), "member_bias": (classes, members)}


def n_parameters(sizes: tuple[int, int]) -> int:
    return sum(math.prod(s) for s in shapes(sizes).values())


def unpack(flat: np.ndarray, sizes: tuple[int, int] = SIZES) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(sizes).items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(sizes: tuple[int, int] = SIZES) -> np.ndarray:
    flat = np.zeros(n_parameters(sizes), np.float32)
    w, rng = unpack(flat, sizes), np.random.default_rng(31)
    for name in ("embed", "to_class", "class_embed", "to_member"):
        w[name][...] = rng.standard_normal(w[name].shape, dtype=np.float32) * 0.1
    return flat


def unigram_biases(flat: np.ndarray, counts: list[int], rest: np.ndarray, sizes: tuple[int, int]) -> None:
    """Sets the biases so that, before training, words and buckets (counts: rest) are predicted by their corpus frequency."""
    w = unpack(flat, sizes)
    n = np.full(w["member_bias"].size, 1e-3)
    n[1 : 1 + len(counts)] += counts
    n[1 + sizes[0] : 1 + sum(sizes)] += rest
    n = n.reshape(w["member_bias"].shape)
    w["class_bias"][...] = np.log(n.sum(1) / n.sum())
    w["member_bias"][...] = np.log(n / n.sum(1, keepdims=True))


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _bounded(x: np.ndarray) -> None:
    """Shifts rows of logits to a largest value of 0 where any is too large to be exponentiated as it is."""
    if max(x.max(), -x.min()) > 60:
        x -= x.max(1, keepdims=True)


def _large(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether logits may be too large to be exponentiated as they are; states are within 1."""
    return not np.abs(weights).sum(0).max() + max(biases.max(), -biases.min()) <= 60


class Output(NamedTuple):
    """What the logits of a batch need of the parameters: those of members are linear in the state and in the class."""

    of_class: np.ndarray  # what the members' logits get of each class
    large_classes: bool
    large_members: bool


def output(w: dict) -> Output:
    of_class = w["class_embed"] @ w["to_member"]
    of_class += w["member_bias"]
    return Output(of_class, _large(w["to_class"], w["class_bias"]), _large(w["to_member"], of_class))


def _state(w: dict, tables, rows) -> np.ndarray:
    """The state made of the words around: rows of the tables."""
    h = tables[0].take(rows[0], axis=0)
    for table, r in zip(tables[1:], rows[1:]):
        h += table.take(r, axis=0)
    h += w["bias"]
    # The hyperbolic tangent; the exponential function takes half the time of tanh.
    h *= -2
    with np.errstate(over="ignore"):
        np.exp(h, out=h)
    h += 1
    np.divide(2, h, out=h)
    h -= 1
    return h


def _logits(w: dict, out: Output, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the classes and of the members of the class c, fit to be exponentiated."""
    x, y = h @ w["to_class"], h @ w["to_member"]
    x += w["class_bias"]
    y += out.of_class.take(c, axis=0)
    if out.large_classes:
        _bounded(x)
    if out.large_members:
        _bounded(y)
    return x, y


def _log_softmax_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of each row of x (which is overwritten) at a column."""
    picked = x.take(np.arange(0, x.size, x.shape[1]) + column).astype(np.float64)
    np.exp(x, out=x)
    return picked - np.log(_row_sums(x))


#: Where the words around stand.
_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])[:, None]


def log_probabilities(w: dict, ids: np.ndarray, at: np.ndarray, out: Output | None = None) -> np.ndarray:
    """out: that of w, where it is at hand."""
    out = out or output(w)
    c, m = np.divmod(ids[at], w["to_member"].shape[1])
    x, y = _logits(w, out, _state(w, w["embed"], ids[at + _AROUND]), c)
    return _log_softmax_at(x, c) + _log_softmax_at(y, m)


def _descend(w: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
    """An adaptive step (gradient is overwritten): each parameter's rate falls with its own summed squares."""
    root = gradient * gradient
    squares += root
    gradient /= np.sqrt(squares, out=root)
    gradient *= RATE
    w -= gradient


def _rows(x: np.ndarray) -> np.ndarray:
    """The rows of a table as single values, which are moved faster than rows of numbers."""
    return x.view(np.dtype((np.void, x.shape[1] * x.itemsize)))[:, 0]


def _distinct(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows out of size: where each one occurs last, where the others are, and for all the place of their last among the lasts."""
    slot, number = np.empty(size, np.int64), np.arange(len(rows))
    slot[rows] = number
    is_last = slot.take(rows) == number
    last, others = np.flatnonzero(is_last), np.flatnonzero(~is_last)
    slot[rows.take(last)] = number[: len(last)]
    return last, others, slot.take(rows)


#: Tables of this process by width (plain: cached functions would travel to workers by name only).
_NUMBERS: dict = {}


def _numbers(shape: tuple[int, int]) -> np.ndarray:
    """The places of a flat table's values, in rows (at least as many as in shape)."""
    rows, width = shape
    if len(_NUMBERS.get(width, ())) < rows:
        _NUMBERS[width] = np.arange(2 * rows * width).reshape(-1, width)
    return _NUMBERS[width]


def _add_rows(total: np.ndarray, place: np.ndarray, values: np.ndarray) -> None:
    """Adds the rows of values to those of total at their places."""
    if values.shape[1] % 2 == 0:  # two numbers at once
        total, values = (x.view(np.complex64 if x.itemsize == 4 else np.complex128) for x in (total, values))
    np.add.at(total.reshape(-1), _numbers(total.shape).take(place, axis=0).reshape(-1), values.reshape(-1))


def _softmax_error(x: np.ndarray, column: np.ndarray, part) -> np.ndarray:
    """Logits (overwritten) to the derivatives of the loss by them: the softmax, less 1 at each row's column, times part."""
    np.exp(x, out=x)
    x *= (part / _row_sums(x))[:, None]
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + column] -= part
    return x


def train_step(w: dict, squares: dict, ids: np.ndarray, at: np.ndarray) -> None:
    """One step on the masked positions."""
    table, table_squares = w["embed"].reshape(-1, DIM), squares["embed"].reshape(-1, DIM)
    near = (ids[at + _AROUND] + np.arange(len(_AROUND))[:, None] * w["embed"].shape[1]).reshape(-1)
    last, others, place = _distinct(near, len(table))
    touched = near.take(last)
    own, near = table.take(touched, axis=0), place.reshape(len(_AROUND), -1)
    c, m = np.divmod(ids[at], w["to_member"].shape[1])
    h, part = _state(w, [own] * len(near), near), own.dtype.type(1 / len(at))
    x, y = _logits(w, output(w), h, c)
    x, y = _softmax_error(x, c, part), _softmax_error(y, m, part)
    dh = x @ w["to_class"].T
    dh += y @ w["to_member"].T
    slope = h * h
    dh *= np.subtract(1, slope, out=slope)
    members = np.zeros_like(w["member_bias"])
    _add_rows(members, c, y)
    to_member, class_embed = h.T @ y, members @ w["to_member"].T
    to_member += w["class_embed"].T @ members
    _descend(w["to_member"], squares["to_member"], to_member)
    _descend(w["to_class"], squares["to_class"], h.T @ x)
    _descend(w["class_bias"], squares["class_bias"], np.ones(len(x), x.dtype) @ x)
    _descend(w["bias"], squares["bias"], np.ones(len(dh), dh.dtype) @ dh)
    _descend(w["member_bias"], squares["member_bias"], members)
    _descend(w["class_embed"], squares["class_embed"], class_embed)
    # Of the embeddings, only the rows that the batch touches.
    gradient = dh.take(last % len(at), axis=0)
    _add_rows(gradient, place.take(others), dh.take(others % len(at), axis=0))
    own_squares = table_squares.take(touched, axis=0)
    _descend(own, own_squares, gradient)
    _rows(table)[touched], _rows(table_squares)[touched] = _rows(own), _rows(own_squares)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out = np.empty(n, np.uint64)
    for a in range(0, n, 1 << 16):  # in pieces that stay in the processor's cache
        part = ends[a : a + (1 << 16) + 1]
        out[a : a + len(part) - 1] = common.range_hash(raw[part[0] : part[-1]], part[:-1] - part[0], part[1:] - part[0])
    return out.view(np.int64)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of texts one after another, and where those of each text begin (and the end)."""
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))[ends]


def _slices(batch: pa.RecordBatch):
    """Rows of a batch of about SLICE_BYTES text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES)))
        yield batch.slice(at, end - at)
        at = end


def id_kind(sizes: tuple[int, int]):
    return np.uint16 if sum(sizes) < 1 << 16 else np.uint32


_TOKENS = "asks boolean, doc_id long, key long, n_words long, ids binary, unknown binary, slice long, bucket int, body binary"
_TOKEN_KINDS = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
_TOKEN_NAMES = [x.split()[0] for x in _TOKENS.split(", ")]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes, so that sorted hashes are sorted by bucket."""
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, from each of ends to the next, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _tokenise(batches, words: list[bytes], sizes: tuple[int, int], buckets: int = 1):
    """A row for each text: ids, and for its words outside the vocabulary their places in the slice's list of distinct ones; that list, by bucket, in rows of its own."""
    known = pa.array([x.decode() for x in words], pa.string())
    vocab, hashed = sizes
    context, number = TaskContext.get(), 0
    for whole in batches:
        for batch in _slices(whole):
            name = (context.partitionId() if context else 0) << 32 | number
            number += 1
            found, ends = split_words(batch.column("text"))
            ids = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy().astype(np.int64) + 1
            new = ids == 0
            unknown = word_hashes(found.filter(pa.array(new)))
            ids[new] = 1 + vocab + unknown % hashed
            distinct, place = np.unique(unknown.view(np.uint64), return_inverse=True)
            bucket = _bucket(distinct, buckets).astype(np.int32)
            n = batch.num_rows
            at = np.concatenate(([0], np.cumsum(new)))[ends]
            none = lambda kind, n=n: pa.nulls(n, kind)
            texts = [pa.array(np.zeros(n, bool)), batch.column("doc_id"), batch.column("key"), pa.array(np.diff(ends)), _binaries(ids.astype(id_kind(sizes)), ends), _binaries(place.astype(np.uint32), at), pa.array(np.full(n, name)), none(pa.int32()), none(pa.binary())]
            yield pa.RecordBatch.from_arrays(texts, names=_TOKEN_NAMES)
            if len(distinct):
                asked = np.unique(bucket)
                first = np.concatenate((np.searchsorted(bucket, asked), [len(bucket)]))
                m = len(asked)
                rows = [pa.array(np.ones(m, bool)), *(pa.nulls(m, k) for k in _TOKEN_KINDS[1:6]), pa.array(np.full(m, name)), pa.array(asked), _binaries(distinct, first)]
                yield pa.RecordBatch.from_arrays(rows, names=_TOKEN_NAMES)


def _pack_counts(batches, buckets: int):
    """Counts (hash, n) to rows (bucket, slice: -1, body: hashes, then counts)."""
    held, size = [], 0

    def out():
        h, n = (np.concatenate(x) for x in zip(*held))
        rows = [(b, h[k].tobytes() + n[k].tobytes()) for b, k in packing_blobs.by_bucket(_bucket(h, buckets).astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([-1] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "slice", "body"])

    for batch in batches:
        held.append((batch.column("hash").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= HELD_COUNTS:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _answer(batches):
    """Rows (bucket, slice, body), sorted by bucket and slice: the logarithms of the counts of each slice's words; of words counted once or never, 0."""
    now, counts, table = None, [], None
    for batch in batches:
        out = []
        for bucket, name, body in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                now, counts, table = bucket, [], None
            if name < 0:
                counts.append(np.frombuffer(body, np.uint64).reshape(2, -1))
                continue
            if table is None:
                h, n = np.concatenate(counts, axis=1) if counts else np.empty((2, 0), np.uint64)
                order = np.argsort(h)
                table, counts = (h[order], np.log(n[order].astype(np.float64)).astype(np.float32)), []
            asked = np.frombuffer(body, np.uint64)
            at = np.minimum(np.searchsorted(table[0], asked), max(0, len(table[0]) - 1))
            found = np.where(table[0][at] == asked, table[1][at], np.float32(0)) if len(table[0]) else np.zeros(len(asked), np.float32)
            out.append((name, bucket, found.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["slice", "bucket", "body"])


def _shares(batches):
    """Rows (slice, bucket, row, body), sorted by slice and bucket, texts last: the sum of the answers for the words of each text."""
    now, parts, table = None, [], None
    for batch in batches:
        rows, sums = [], []
        for name, _, row, body in zip(*(c.to_pylist() for c in batch.columns)):
            if name != now:
                now, parts, table = name, [], None
            if row is None:
                parts.append(body)
                continue
            if table is None:
                table, parts = np.frombuffer(b"".join(parts), np.float32).astype(np.float64), []
            rows.append(row)
            sums.append(float(table[np.frombuffer(body, np.uint32)].sum()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sums, pa.float64())], names=["__row", "shares"])


def _pieces(body: bytes, sizes: tuple[int, int]):
    """Ids of at most PIECE words at a time, between those of the SIDE words before and after (zeros: none)."""
    ids = np.frombuffer(body, id_kind(sizes))
    whole = np.zeros(len(ids) + 2 * SIDE, np.int64)
    whole[SIDE : SIDE + len(ids)] = ids
    for at in range(0, len(ids), PIECE):
        yield whole[at : at + PIECE + 2 * SIDE]


def _inner(held: list[np.ndarray]) -> np.ndarray:
    """Positions of the pieces' own words in their joined ids."""
    inside = np.ones(sum(map(len, held)), bool)
    ends = np.cumsum([len(x) for x in held])
    for k in range(SIDE):
        inside[ends - 1 - k] = False
        inside[ends - [len(x) for x in held] + k] = False
    return np.flatnonzero(inside)


def residues(turn: int, rounds: int) -> list[int]:
    """Those trained on in a round."""
    return list(range(turn % MASK, MASK, rounds))


def _train(batches, sizes: tuple[int, int], start: bytes, turn: int, rounds: int):
    """batches (shard, ids), sorted by shard, to the blocks of each shard's weights, multiplied by the positions trained on."""
    now, held, size, seen = None, [], 0, 0
    flat = squares = None

    def step():
        ids = np.concatenate(held)
        own, n, w, own_squares = _inner(held), 0, unpack(flat, sizes), unpack(squares, sizes)
        for residue in residues(turn, rounds):
            at = own[own % MASK == residue]
            for part in np.array_split(at, max(1, round(len(at) / TRAIN_BATCH))):
                if len(part):
                    train_step(w, own_squares, ids, part)
            n += len(at)
        return n

    def blocks():
        body = [(flat[k : k + BLOCK] * np.float32(seen)).tobytes() for k in range(0, len(flat), BLOCK)]
        n = len(body)
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(np.full(n, now, np.int64)), pa.array(np.full(n, seen)), pa.array(body, pa.binary())], names=["block", "shard", "seen", "body"])

    for batch in batches:
        for shard, body in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
            if shard != now:
                if held:
                    seen += step()
                if seen:
                    yield blocks()
                now, held, size, seen = shard, [], 0, 0
                flat, squares = np.frombuffer(start, np.float32).copy(), np.full(len(start) // 4, 1e-4 + 1e-6, np.float32)
            for part in _pieces(body, sizes):
                held.append(part)
                size += len(part) - 2 * SIDE
                if size >= MASK * TRAIN_BATCH:
                    seen += step()
                    held, size = [], 0
    if held:
        seen += step()
    if seen:
        yield blocks()


def _average(batches):
    """Sums of blocks of one task: (block, shard, seen, body), from rows sorted by block and shard."""
    now, total, seen = None, None, 0
    out = []
    for batch in batches:
        for block, _, n, body in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                if now is not None:
                    out.append((now, (total / seen).astype(np.float32).tobytes()))
                now, total, seen = block, 0.0, 0
            total, seen = total + np.frombuffer(body, np.float32).astype(np.float64), seen + n
    if now is not None:
        out.append((now, (total / seen).astype(np.float32).tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "body"])


def _summed(held: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(held).group_by(["word", "hash"]).aggregate([("n", "sum")])
    return total.rename_columns(["word", "hash", "n"])


def _count_words(batches):
    """Word counts of a task to rows (bucket, body: a stream of words, hashes and counts); they go out whenever many are held."""
    held: list[pa.Table] = []

    def out():
        total = _summed(held).combine_chunks()
        bucket = _bucket(total.column("hash").to_numpy().view(np.uint64), COUNT_BUCKETS).astype(np.uint16)
        total, bodies = total.take(pa.array(np.argsort(bucket, kind="stable"))).combine_chunks(), []
        asked, n = np.unique(bucket, return_counts=True)
        for end, rows in zip(np.cumsum(n).tolist(), n.tolist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, total.schema) as stream:
                stream.write_table(total.slice(end - rows, rows))
            bodies.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    for whole in batches:
        for batch in _slices(whole):
            found = pc.value_counts(split_words(batch.column("text"))[0])
            if len(found):
                words = found.field("values")
                held.append(pa.table({"word": words.cast(pa.binary()), "hash": word_hashes(words), "n": found.field("counts")}))
                if sum(map(len, held)) > HELD_COUNTS:
                    yield out()
                    held.clear()
    if held:
        yield out()


def _merge_counts(batches):
    """Rows of _count_words, sorted by bucket, to the counts of each bucket's words."""
    now, held = None, []
    for batch in batches:
        for bucket, body in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if held:
                    yield from _summed(held).to_batches()
                now, held = bucket, []
            held.append(pa.ipc.open_stream(body).read_all())
            if len(held) > 1 and sum(map(len, held)) > HELD_COUNTS:
                held = [_summed(held)]
    if held:
        yield from _summed(held).to_batches()


class Lexicon(NamedTuple):
    words: list[bytes]
    sizes: tuple[int, int]
    total: int  # words of the corpus
    distinct: int
    rest: np.ndarray  # occurrences in each bucket
    counts: DataFrame  # hash, n of the words outside the vocabulary that occur more than once


def lexicon(texts: DataFrame) -> tuple[Lexicon, list[int]]:
    """What is counted in all of texts, and the counts of the vocabulary."""
    parts = texts.mapInArrow(lambda it: common.tidy(_count_words(it)), "bucket int, body binary")
    counts = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: common.tidy(_merge_counts(it)), "word binary, hash long, n long")
    counts = common.materialise(counts, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, math.isqrt(total) // OFTEN)
    sizes = sizes_for(counts.filter(F.col("n") >= least).count())
    vocab, buckets = sizes
    top = counts.orderBy(F.desc("n"), "word").limit(vocab).collect()  # grows with the root of the corpus
    rest = np.zeros(buckets)
    rows = counts.groupBy(F.pmod("hash", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n"))
    for r in rows.collect():
        rest[r["bucket"]] = r["n"]
    for r in top:
        rest[r["hash"] % buckets] -= r["n"]
    # Where the least count of the vocabulary is reached, words in it may be left in the table; they are never looked up.
    few = counts.filter((F.col("n") > 1) & (F.col("n") <= (top[-1]["n"] if top else 0))).groupBy("hash").agg(F.sum("n").alias("n"))
    return Lexicon([bytes(r["word"]) for r in top], sizes, total, distinct, rest, few), [r["n"] for r in top]


def n_shards(known: Lexicon) -> int:
    return common.pieces(known.total, max(SHARD_WORDS, SHARD_ROOTS * math.isqrt(known.total)))


def n_buckets(known: Lexicon) -> int:
    return common.pieces(known.distinct, BUCKET_WORDS)


def tokens(docs: DataFrame, known: Lexicon) -> DataFrame:
    """The tokens of every document and what is asked of the counts, as a table with rows in order of shard and key (of id and text)."""
    (words, sizes), shards, buckets = known[:2], n_shards(known), n_buckets(known)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = rows.mapInArrow(lambda it: common.tidy(_tokenise(it, words, sizes, buckets)), _TOKENS)
    rows = rows.withColumn("shard", F.pmod(F.coalesce("key", "slice"), F.lit(shards)))
    dealt = rows.repartition(2 * shards, "shard").sortWithinPartitions("shard", "key")
    return common.materialise(dealt.withColumn("row", F.monotonically_increasing_id()), "tokens")


def train(rows: DataFrame, known: Lexicon, counts: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """Parameters, from the tokens of all documents."""
    sizes = known.sizes
    flat = initial(sizes)
    unigram_biases(flat, counts, known.rest, sizes)
    dealt = rows.filter("not asks and n_words > 0").select("shard", "ids")
    for turn in range(rounds):
        start = flat.tobytes()
        parts = dealt.mapInArrow(lambda it, s=start, t=turn: common.tidy(_train(it, sizes, s, t, rounds)), "block int, shard long, seen long, body binary")
        summed = parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average, "block int, body binary")
        found = {r["block"]: r["body"] for r in summed.collect()}  # one copy of the parameters
        if found:
            flat = np.frombuffer(b"".join(found[k] for k in sorted(found)), np.float32)
    return flat


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Lexicon, np.ndarray]:
    """Vocabulary with counts, and parameters, from all of docs (doc_id, text)."""
    known, n = lexicon(docs.select("text"))
    return known, train(tokens(docs, known), known, n, rounds)


def _score(batches, sizes: tuple[int, int], rest: np.ndarray, body: bytes):
    """Sums by the network, a word outside the vocabulary taken as one of the occurrences in its bucket (and one more, of words never counted)."""
    w = unpack(np.frombuffer(body, np.float32), sizes)
    out = output(w)
    one = np.zeros(1 + sum(sizes))
    one[1 + sizes[0] :] = np.log(rest + 1)
    for batch in batches:
        total, in_vocabulary = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        held, owner, size = [], [], 0

        def flush():
            ids = np.concatenate(held)
            at = _inner(held)
            doc = np.repeat(owner, [len(x) for x in held])[at]
            lp = np.concatenate([log_probabilities(w, ids, at[k : k + BATCH], out) for k in range(0, len(at), BATCH)])
            total[:] += np.bincount(doc, lp - one[ids[at]], len(total))
            in_vocabulary[:] += np.bincount(doc, ids[at] <= sizes[0], len(total)).astype(np.int64)

        for k, ids in enumerate(batch.column("ids").to_pylist()):
            for part in _pieces(ids, sizes):
                held.append(part)
                owner.append(k)
                size += len(part)
                if size >= 8 * BATCH:
                    flush()
                    held, owner, size = [], [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_words")), pa.array(in_vocabulary), pa.array(total)], names=["row", "doc_id", "n_words", "n_in_vocabulary", "total"])


def score_tokens(rows: DataFrame, known: Lexicon, flat: np.ndarray) -> DataFrame:
    """The scores of a table of tokens."""
    body, sizes, rest = flat.astype(np.float32).tobytes(), known.sizes, known.rest
    texts = rows.filter("not asks")
    scored = texts.select("row", "doc_id", "n_words", "ids").mapInArrow(lambda it: common.tidy(_score(it, sizes, rest, body)), "row long, doc_id long, n_words long, n_in_vocabulary long, total double")
    buckets = n_buckets(known)
    counts = known.counts.select("hash", "n").mapInArrow(lambda it: _pack_counts(it, buckets), "bucket int, slice long, body binary")
    asked = counts.union(rows.filter("asks").select("bucket", "slice", "body"))
    answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice").mapInArrow(lambda it: common.tidy(_answer(it)), "slice long, bucket int, body binary")
    own = texts.filter(F.octet_length("unknown") > 0).select("slice", F.lit(None).cast("int").alias("bucket"), "row", F.col("unknown").alias("body"))
    both = answers.select("slice", "bucket", F.lit(None).cast("long").alias("row"), "body").union(own)
    shares = both.repartition("slice").sortWithinPartitions("slice", F.col("bucket").asc_nulls_last()).mapInArrow(lambda it: common.tidy(_shares(it)), "__row long, shares double")
    total = F.col("total") + F.coalesce("shares", F.lit(0.0))
    joined = scored.join(shares, F.col("row") == F.col("__row"), "left")
    return joined.select("doc_id", "n_words", "n_in_vocabulary", total.alias("pseudo_log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))


def score(docs: DataFrame, known: Lexicon, flat: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_in_vocabulary, pseudo_log_likelihood, mean_log_probability of every document."""
    return score_tokens(tokens(docs, known), known, flat)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Fits on all documents, then scores them all."""
    known, n = lexicon(docs.select("text"))
    rows = tokens(docs, known)
    return score_tokens(rows, known, train(rows, known, n, rounds))
