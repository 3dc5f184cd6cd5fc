"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

Each distinct shingle set gets COORDINATES minhash values. TREES independent trees branch
the sets: a node picks a coordinate by a hash of its path, and its sets go on to children by
their minhash there. The first DEPTH levels pick one coordinate; deeper ones, which only
nodes of more than LEAF sets reach, pick BRANCH coordinates each. Two sets of similarity s stay
together through a level with probability s (or 1 - (1 - s) ** BRANCH); at 0.8 the trees
together miss a link with probability below 1e-5. Nodes of at most LEAF sets are compared
exhaustively. A large node of which DENSE or more comes from its parent holds sets that are close to
each other, which branching would not separate: it is dealt into parts of PART sets that all get
the same HUBS sets and are compared exhaustively, and what is not linked to the node's main
component is afterwards compared, on full sets, with itself and that component in pairs of tiles of TILE sets. No node
is compared in one task, and such a pair of tiles reports a spanning forest of its links only.

Comparisons go by two sketches: a parity sketch of ODD_BITS bits, whose Hamming distance
bounds the symmetric difference, then the low bytes of the minhash values; both pass what is within
SIGMAS standard errors of the threshold. Candidates are confirmed on the full sets (as 64-bit hashes of
shingles). A first round takes, in each task, a spanning forest of the candidates, closest
first; a second round takes all candidate pairs that are still in different components, so no
pair of candidates between components is left unconfirmed.

Rules for odd input: equal sets are one set with many documents and are linked; null or
wordless texts have the empty set and link with nothing; documents with fewer words than a
shingle have one shingle, the whole sequence; rows with equal ids are documents of their own;
documents with a null id get a null component and are kept; very long texts are hashed in parts;
an empty table gives an empty result. Columns beside doc_id and text aren't read.

Sets that are close to each other but not linked, such as pages of one template, have to be compared with each other at any
depth, as branching hardly tells 0.75 from 0.8; m of them take m * m / 2 comparisons, in tiles, and m / TILE copies of a set.

Scale: rows of 16 bytes are dealt to nodes; sketches follow only for nodes of two or more
sets; full sets travel only for candidates. Equal copies and hubs are the groups that can hold
a third of all rows: the first are collapsed by a partial aggregate, the second are dealt into leaves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .components import components
from .running import same

COORDINATES = 64
TREES = 16
DEPTH = 2
MAX_DEPTH = 8
BRANCH = 2
LEAF = 64
DENSE = 0.5
PART = 1024
HUBS = 4
#: Sets in a tile, and shingles counted at once.
TILE = 512
COLUMNS = 4096
#: Candidate pairs that a task holds before it takes a spanning forest of them.
HELD_PAIRS = 200_000
ODD_BITS = 1024
SIGMAS = 4.0
SLICE_BYTES = 1 << 20
#: Texts from this length on are hashed in parts.
LONG = 4 << 20

_SIGNED = "doc_id long, __rk long, n_shingles long, setkey binary, sig binary, odd binary"


def _multipliers() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    rows = [x.lower().split() for x in texts]
    count = np.array([len(w) for w in rows], np.int64)
    raw = b" ".join(b" ".join(w) for w in rows if w) + b" "
    buf = np.frombuffer(raw, np.uint8)
    out = [np.empty(0, np.uint64)] * len(rows)
    if not count.any():
        return out
    ends = np.flatnonzero(buf == 32)
    starts = np.append(0, ends[:-1] + 1)
    first = np.cumsum(count) - count
    s, inverse = common.prefix_hash(buf)
    last = np.minimum(np.arange(len(ends)) + size - 1, len(ends) - 1)
    h = common.mix((s[ends[last]] - s[starts]) * inverse[starts])
    for k, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        if n >= size:
            out[k] = np.unique(h[a : a + n - size + 1])
        elif n:
            i, j = starts[a], ends[a + n - 1]
            out[k] = common.mix((s[j : j + 1] - s[i : i + 1]) * inverse[i : i + 1])
    return out


def _long_hashes(text: bytes, size: int) -> np.ndarray:
    """The same of one very long text, from parts that overlap by a shingle less a word."""
    out, kept, few = [], [], True
    for words in common.word_parts(text, SLICE_BYTES):
        few, words = few and not out and len(kept) + len(words) < size, kept + words
        if len(words) >= size:
            out.append(_hashes([b" ".join(words)], size)[0])
        kept = words[max(0, len(words) - size + 1) :]
        if len(out) >= 16:  # repeats go as they come
            out = [np.unique(np.concatenate(out))]
    if few:
        return _hashes([b" ".join(kept)], size)[0]
    return np.unique(np.concatenate(out))


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (words lower-cased in ASCII)."""
    if sum(map(len, texts)) > LONG:
        return [_long_hashes(x, size) if len(x) > LONG else _hashes([x], size)[0] for x in texts]
    return _hashes(texts, size)


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """ODD_BITS bits, each the parity of the number of members hashed to it."""
    place = ((members * np.uint64(0xA24BAED4963EE407)) >> np.uint64(40)) % np.uint64(ODD_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=ODD_BITS) & 1)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for text in spans.texts(batch.column(column)):
        held.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _sign(batches, size: int):
    mult = _multipliers()
    for batch in batches:
        for at, texts in _slices(batch, "text"):
            sets = shingle_hashes(texts, size)
            n = np.array([len(x) for x in sets], np.int64)
            sig = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
            some = np.flatnonzero(n)
            if len(some):
                flat = np.concatenate([sets[k] for k in some])
                cut = np.cumsum(n[some]) - n[some]
                for c in range(COORDINATES):
                    x = flat * mult[c]
                    x ^= x >> np.uint64(31)
                    x *= np.uint64(0xBF58476D1CE4E5B9)
                    sig[some, c] = (np.minimum.reduceat(x, cut) >> np.uint64(32)).astype(np.uint32)
            part = batch.slice(at, len(sets))
            odd = [parity_sketch(x).tobytes() for x in sets]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__rk"), pa.array(n), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(odd, pa.binary())], names=["doc_id", "__rk", "n_shingles", "setkey", "sig", "odd"])


def _hash2(a: np.ndarray, b) -> np.ndarray:
    return common.mix(np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64))


def _step(node: np.ndarray, sig: np.ndarray, branch: int) -> np.ndarray:
    """The child of each row's node by its branch-th coordinate."""
    pick = _hash2(node, np.full(len(node), branch + 1))
    coordinate = (pick % np.uint64(COORDINATES)).astype(np.int64)
    return _hash2(pick, sig[np.arange(len(node)), coordinate])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        uid, sig = batch.column("uid").to_numpy(), _signatures(batch.column("sig"))
        for tree in range(TREES):
            node = _hash2(np.full(len(uid), tree), np.full(len(uid), 12345))
            for _ in range(DEPTH):
                node = _step(node, sig, 0)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(uid)], names=["node", "uid"])


def _children(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        node, sig = batch.column("node").to_numpy().view(np.uint64), _signatures(batch.column("sig"))
        for k in range(BRANCH):
            yield pa.RecordBatch.from_arrays([pa.array(_step(node, sig, k).view(np.int64)), batch.column("uid"), batch.column("above")], names=["node", "uid", "above"])


_ROWS = ("leaf", "uid", "comp", "n", "sketch", "odd")
_PLACED = ("node", "wide", "first", "places")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    if name == "sketch":
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    if name == "odd":
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, ODD_BITS // 64)
    if name == "places":
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        out = np.empty(len(column), object)
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            out[k] = flat[a:b]
        return out
    return column.to_numpy(zero_copy_only=False)


def _grouped(batches, names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Whole leaves at a time, from rows sorted by leaf, the first column."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [_column(batch, c) for c in names]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last leaf may go on
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield rest


def _reports(i: np.ndarray, j: np.ndarray, uid, node, wide, first, places) -> np.ndarray:
    """Of pairs in a leaf, those that this leaf reports: it is in the smallest node where the two meet, and two sets that stand in all its parts meet in its first."""
    known: dict[int, dict[int, int]] = {}

    def at(k: int) -> dict[int, int]:
        if (d := known.get(int(uid[k]))) is None:
            p = places[k].tolist()
            d = known[int(uid[k])] = dict(zip(p[::2], p[1::2]))
        return d

    out = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        if wide[a] and wide[b] and not first[a]:
            continue
        x, y = at(a), at(b)
        here = node[a]
        out[k] = not any(n < here and n in y and (m == y[n] or not m or not y[n]) for n, m in x.items())
    return out


def _most_odd(total: np.ndarray, threshold: float) -> np.ndarray:
    """The Hamming distance of parity sketches that sets of the threshold's similarity and this total size seldom pass."""
    differ = total * ((1 - threshold) / (1 + threshold))
    fall = np.exp(-2 * differ / ODD_BITS)
    spread = ODD_BITS / 4 * (1 - fall * fall) - differ * fall * fall  # of a fixed number of members thrown into ODD_BITS places
    return ODD_BITS / 2 * (1 - fall) + SIGMAS * np.sqrt(np.maximum(spread, 0)) + 2


def _least_matches(threshold: float) -> float:
    p = threshold + (1 - threshold) / 256
    return COORDINATES * p - SIGMAS * math.sqrt(COORDINATES * p * (1 - p))


def _candidates(leaf, uid, comp, n, sketch, odd, threshold: float):
    """Pairs of rows of one leaf in different components whose sketches agree enough: (i, j, matches)."""
    least = _least_matches(threshold)
    for k in range(1, len(leaf)):
        i = np.flatnonzero(leaf[k:] == leaf[:-k])
        if not len(i):
            return
        i = i[comp[i] != comp[i + k]]
        i = i[np.minimum(n[i], n[i + k]) >= threshold * np.maximum(n[i], n[i + k])]
        if len(i):
            i = i[np.bitwise_count(odd[i] ^ odd[i + k]).sum(1) <= _most_odd(n[i] + n[i + k], threshold)]
        if len(i):
            matches = (sketch[i] == sketch[i + k]).sum(1)
            good = matches >= least
            if good.any():
                yield i[good], i[good] + k, matches[good]


def _spanning(x: np.ndarray, y: np.ndarray, matches: np.ndarray, root, parent: dict) -> np.ndarray:
    """Indices of pairs of components (x, y) that form a spanning forest, closest pairs first."""
    order = np.argsort(-matches, kind="stable")
    keep: list[int] = []
    while len(order):
        ids, back = np.unique(np.concatenate((x[order], y[order])), return_inverse=True)
        roots = np.array([root(int(c)) for c in ids], np.int64)
        a, b = roots[back[: len(order)]], roots[back[len(order) :]]
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        # the closest pair of each component
        for k in np.unique(np.concatenate((np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]))).tolist():
            p, q = root(int(a[k])), root(int(b[k]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                keep.append(order[k])
    return np.array(keep, np.int64)


def _pairs(batches, threshold: float, spanning: bool):
    parent: dict[int, int] = {}

    def root(x):
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    def chosen(found: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        uid, comp = rows[1], rows[2]
        i, j, m = (np.concatenate(x) for x in zip(*found))
        if spanning:
            keep = _spanning(comp[i], comp[j], m.astype(np.int64), root, parent)
            ids, back = np.unique(comp, return_inverse=True)
            comp[:] = np.array([root(int(c)) for c in ids], np.int64)[back]
        else:
            keep = _reports(i, j, uid, *rows[len(_ROWS) :])
        i, j = i[keep], j[keep]
        pairs = np.unique(np.column_stack((np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j]))), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for rows in _grouped(batches, _ROWS if spanning else (*_ROWS, *_PLACED)):
        rows[2] = rows[2].copy()  # components, brought up to date as the forest grows
        found, size = [], 0
        for x in _candidates(*rows[: len(_ROWS)], threshold):
            found.append(x)
            size += len(x[0])
            if size >= HELD_PAIRS:
                yield chosen(found, rows)
                found, size = [], 0
        if found:
            yield chosen(found, rows)


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, by products of their membership columns."""
    code = np.unique(np.concatenate(x)), np.unique(np.concatenate(y))
    both = np.intersect1d(*code, assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (r1, c1), (r2, c2) = places(x), places(y)
    for a in range(0, len(both), COLUMNS):
        n = min(COLUMNS, len(both) - a)
        sides = []
        for r, c, m in ((r1, c1, len(x)), (r2, c2, len(y))):
            i, j = np.searchsorted(c, (a, a + n))
            block = np.zeros((m, n), np.float32)
            block[r[i:j], c[i:j] - a] = 1
            sides.append(block)
        out += sides[0] @ sides[1].T  # counts are exact below 2 ** 24
    return out


def _tile_links(batches, percent: int):
    """Of pairs of tiles (rows sorted by tile: tile, side, uid, comp, members), links that join components: a spanning forest."""
    parent: dict[int, int] = {}

    def root(v):
        while (w := parent.get(v, v)) != v:
            parent[v] = parent.get(w, w)
            v = w
        return v

    def solve(rows):
        side = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        n, comp = np.array([len(v) for v in sets], np.int64), [r[3] for r in rows]
        first = np.flatnonzero(side <= 1)
        second = np.flatnonzero(side == 2) if (side == 2).any() else first
        if not len(first):
            return []
        k = _shared([sets[i] for i in first], [sets[j] for j in second]).astype(np.int64)
        i, j = np.nonzero(100 * k >= percent * (n[first][:, None] + n[second][None, :] - k))
        out = []
        for a, b in zip(first[i].tolist(), second[j].tolist()):
            p, q = root(comp[a]), root(comp[b])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((rows[a][2], rows[b][2]))
        return out

    def batch_of(found):
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and rows:
                if found := solve(rows):
                    yield batch_of(found)
                rows = []
            now = row[0]
            rows.append(row)
    if rows and (found := solve(rows)):
        yield batch_of(found)


def _pack_sets(batches, size: int):
    for batch in batches:
        for at, texts in _slices(batch, "text"):
            sets = shingle_hashes(texts, size)
            yield pa.RecordBatch.from_arrays([batch.slice(at, len(sets)).column("uid"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["uid", "members"])


def _confirm(batches, percent: int):
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])


class _Join:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs
        signed = docs.select("doc_id", "__rk", "text").mapInArrow(lambda it: common.tidy(_sign(it, size)), _SIGNED)
        self.signed = common.materialise(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        known = self.signed.filter("setkey is not null and doc_id is not null")
        classes = known.groupBy("setkey").agg(F.min("row").alias("uid"), F.min("doc_id").alias("least_doc"), F.first("sig").alias("sig"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n"), F.min_by(F.struct("doc_id", "__rk"), "row").alias("at"))
        self.classes = common.materialise(classes, "classes")

    def nodes(self) -> tuple[DataFrame, DataFrame | None]:
        """Rows (node, leaf, uid, wide, first) of the small nodes; and of those dealt into parts.

        wide: the set stands in every part of its node; first: the leaf is the node's first part.
        """
        rows = self.classes.select("uid", "sig").mapInArrow(_roots, "node long, uid long").withColumn("above", F.lit(None).cast("long"))
        leaves, dense, level = [], [], DEPTH
        while True:
            rows = common.materialise(rows, "nodes")
            # a table of its own, so that the join has two exchanges and Spark can split a node that holds very many rows
            counts = common.materialise(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("node", "__node"), "counts")
            sized = common.materialise(rows.join(counts, rows["node"] == counts["__node"]).drop("__node"), "sized")
            leaves.append(sized.filter(f"n <= {LEAF}").select("node", F.col("node").alias("leaf"), "uid", F.lit(False).alias("wide"), F.lit(True).alias("first")))
            close = F.coalesce(F.col("n") >= DENSE * F.col("above"), F.lit(False)) | F.lit(level >= MAX_DEPTH)
            dense.append(sized.filter(f"n > {LEAF}").filter(close))
            large = sized.filter(f"n > {LEAF}").filter(~close)
            if large.limit(1).count() == 0:
                break
            level += 1
            sig = self.classes.select(F.col("uid").alias("__uid"), "sig")
            rows = large.join(sig, large["uid"] == sig["__uid"]).select("node", "uid", "sig", F.col("n").alias("above")).mapInArrow(_children, "node long, uid long, above long").dropDuplicates(["node", "uid"])
        large = _union(dense)
        if large.limit(1).count() == 0:
            return _union(leaves), None
        parts = F.ceil(F.col("n") / F.lit(PART - HUBS)).cast("long")
        dealt = large.select("node", "uid", F.pmod(F.xxhash64("node", "uid"), parts).alias("part"))
        hubs = large.groupBy("node").agg(F.array_distinct(F.array(*(F.min_by("uid", F.xxhash64(F.lit(k), "uid")) for k in range(HUBS)))).alias("hub"), F.first(parts).alias("parts"))
        hubs = hubs.withColumn("uid", F.explode("hub")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("node", "uid", "part")
        chunked = dealt.withColumn("wide", F.lit(False)).union(hubs.withColumn("wide", F.lit(True)))
        chunked = chunked.select("node", F.xxhash64(F.lit(7), "node", "part").alias("leaf"), "uid", "wide", (F.col("part") == 0).alias("first"))
        return _union(leaves), common.materialise(_once(chunked), "chunked")

    def candidates(self, leaves: DataFrame, comp: DataFrame | None) -> DataFrame:
        """Leaf rows to pairs (a, b): without comp a spanning forest of each task's candidates, else all that cross components."""
        if comp is None:
            rows = leaves.withColumn("comp", F.col("uid"))
        else:  # only leaves that hold two components
            of = comp.select(F.col("id").alias("__id"), "component")
            rows = leaves.join(of, leaves["uid"] == of["__id"], "left").withColumn("comp", F.coalesce("component", "uid")).drop("__id", "component")
            mixed = rows.groupBy("leaf").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.col("leaf").alias("__leaf"))
            rows = common.materialise(rows.join(mixed, rows["leaf"] == mixed["__leaf"], "left_semi"), "mixed")
            # where each set stands, at most once a node: of the leaves that two sets share, one reports the pair
            stands = rows.groupBy("uid").agg(F.flatten(F.collect_set(F.array("node", F.when(F.col("wide"), 0).otherwise(F.col("leaf"))))).alias("places")).withColumnRenamed("uid", "__at")
            rows = rows.join(stands, rows["uid"] == stands["__at"]).drop("__at")
        sketch = self.classes.select(F.col("uid").alias("__uid"), "n", "sig", "odd").mapInArrow(_to_sketch, "__uid long, n long, sketch binary, odd binary")
        rows = rows.join(sketch, rows["uid"] == sketch["__uid"]).drop("__uid")
        sorted_rows = rows.repartition("leaf").sortWithinPartitions("leaf")
        threshold, spanning = self.percent / 100, comp is None
        pairs = sorted_rows.mapInArrow(lambda it: common.tidy(_pairs(it, threshold, spanning)), "a long, b long")
        return pairs.distinct() if spanning else pairs

    def sets(self, ids: DataFrame) -> DataFrame:
        """uid, members of distinct uids: full sets, from the texts."""
        at = self.classes.select(F.col("uid").alias("__uid"), "at.*").withColumnsRenamed({"doc_id": "__doc", "__rk": "__key"})
        at = ids.join(at, ids["uid"] == at["__uid"]).drop("__uid")
        docs = self.docs.select("doc_id", "__rk", "text")
        texts = docs.join(at, (docs["doc_id"] == at["__doc"]) & (docs["__rk"] == at["__key"])).select("uid", "text")
        size = self.size
        return common.materialise(texts.mapInArrow(lambda it: common.tidy(_pack_sets(it, size)), "uid long, members binary").dropDuplicates(["uid"]), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with linked, by their full sets."""
        sets = self.sets(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())
        x, y = sets.select(F.col("uid").alias("__a"), F.col("members").alias("x")), sets.select(F.col("uid").alias("__b"), F.col("members").alias("y"))
        full = pairs.join(y, pairs["b"] == y["__b"]).select("a", "b", "y")
        full = full.join(x, full["a"] == x["__a"]).select("a", "b", "x", "y")
        percent = self.percent
        return common.materialise(full.mapInArrow(lambda it: common.tidy(_confirm(it, percent)), "a long, b long, linked boolean"), "confirmed")

    def run(self) -> DataFrame:
        """(setkey, least_doc of the component) of each distinct set."""
        leaves, chunked = self.nodes()
        both = common.materialise(leaves if chunked is None else leaves.union(chunked), "leaves")
        tried = self.confirmed(common.materialise(self.candidates(both, None), "pairs"))
        comp = common.materialise(components(tried.filter("linked")), "components")
        pairs = self.candidates(leaves, comp)
        seen = tried.filter("not linked").select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        pairs = common.materialise(pairs.join(seen, (pairs["a"] == seen["__a"]) & (pairs["b"] == seen["__b"]), "left_anti"), "pairs")
        more = []
        if pairs.limit(1).count():
            more.append(self.confirmed(pairs).filter("linked").select("a", "b"))
        if chunked is not None and (rest := self._rest(chunked, comp)) is not None:
            more.append(rest)
        if more:
            links = _union(more)
            if links.limit(1).count():
                comp = common.materialise(components(tried.filter("linked").select("a", "b").union(links)), "components")
        of = comp.select(F.col("id").alias("__id"), "component")
        joined = self.classes.select("setkey", "uid", "least_doc").join(of, F.col("uid") == F.col("__id"), "left").withColumn("comp", F.coalesce("component", "uid"))
        least = joined.groupBy("comp").agg(F.min("least_doc").alias("component_id")).withColumnRenamed("comp", "__comp")
        return joined.join(least, joined["comp"] == least["__comp"]).select(F.col("setkey").alias("__set"), "component_id", "comp")

    def _rest(self, chunked: DataFrame, comp: DataFrame) -> DataFrame | None:
        """Links (a, b) of sets outside the main component of their dense node with each other and with that component."""
        of = comp.select(F.col("id").alias("__id"), "component")
        rows = chunked.select("node", "uid").distinct()
        rows = rows.join(of, rows["uid"] == of["__id"], "left").withColumn("comp", F.coalesce("component", "uid")).drop("__id", "component")
        sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("node").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
        tiles = lambda c: F.ceil(c / F.lit(TILE)).cast("long")
        main = main.select(F.col("node").alias("__node"), "main", tiles(F.col("n") - F.col("n_main")).alias("own"), tiles(F.col("n_main")).alias("others"))
        rows = common.materialise(rows.join(main, rows["node"] == main["__node"]).drop("__node"), "rest")
        if rows.limit(1).count() == 0:
            return None
        numbers = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
        tile = lambda c: F.pmod(F.xxhash64("uid", "node"), c)
        key = lambda kind, i, j: F.xxhash64(F.lit(kind), "node", i, j).alias("tile")
        rest = rows.filter("comp != main").withColumn("mine", tile(F.col("own")))
        each = rest.withColumn("other", F.explode(numbers(F.col("own"))))
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        within = each.select(key("within", F.least("mine", "other"), F.greatest("mine", "other")), side.alias("side"), "uid", "comp")
        across = rest.withColumn("other", F.explode(numbers(F.col("others")))).select(key("across", F.col("mine"), F.col("other")), F.lit(1).alias("side"), "uid", "comp")
        kept = rows.filter("comp = main").withColumn("mine", tile(F.col("others"))).withColumn("other", F.explode(numbers(F.col("own"))))
        kept = kept.select(key("across", F.col("other"), F.col("mine")), F.lit(2).alias("side"), "uid", "comp")
        dealt = within.union(across).union(kept)
        sets = self.sets(rows.select("uid").distinct()).withColumnRenamed("uid", "__uid")
        whole = dealt.join(sets, dealt["uid"] == sets["__uid"]).select("tile", "side", "uid", "comp", "members")
        percent = self.percent
        found = whole.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda it: common.tidy(_tile_links(it, percent)), "a long, b long")
        return common.materialise(found, "rest-links")


def _to_sketch(batches):
    for batch in batches:
        if batch.num_rows:
            sketch = (_signatures(batch.column("sig")) & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("__uid"), batch.column("n"), pa.array([r.tobytes() for r in sketch], pa.binary()), batch.column("odd")], names=["__uid", "n", "sketch", "odd"])


def _once(rows: DataFrame) -> DataFrame:
    """Leaf rows with each set once a leaf, wide if it is so anywhere there."""
    return rows.groupBy("node", "leaf", "uid").agg(F.max("wide").alias("wide"), F.max("first").alias("first"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, __rk, row, group, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    join = _Join(common.with_row_key(docs.select("doc_id", "text")), size, percent)
    found = join.run()
    rows = join.signed.join(found, join.signed["setkey"].eqNullSafe(found["__set"]), "left")
    component = F.coalesce("component_id", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    group = F.coalesce("comp", -F.col("row") - 1)  # of the empty set: each row a group
    return rows.select("doc_id", "__rk", "row", group.alias("group"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicate_digest(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


@common.keeping_columns
def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; of rows that share the smallest id one stays."""
    names = docs.columns
    keyed = common.with_row_key(docs)
    found = near_duplicates(docs, size, percent).filter("kept")
    one = found.filter("doc_id is not null").groupBy("group").agg(F.min(F.struct("doc_id", "row", "__rk")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.__rk").alias("__key"))
    nulls = keyed.filter("doc_id is null").select(*names)
    joined = keyed.join(one, same(keyed, one, [("doc_id", "__id"), ("__rk", "__key")]), "left_semi")
    if not common.unique_ids(docs):  # equal rows of one id
        joined = joined.dropDuplicates(["doc_id", "__rk"])
    return joined.select(*names).union(nulls)
