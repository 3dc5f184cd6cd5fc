"""Near-duplicate vectors by sorted projection passes.

Equal vectors are first collapsed to one with a weight. In each pass a vector's
key is the concatenation of HASHES random sign hashes of its unit vector less the mean of all; keys and ids are range-sorted and
each vector is compared, by cosine of the vectors themselves in double precision, with the window that follows it, wherever a partition ends: the sorted
rows are numbered, and dealt in runs of SPAN windows with the window after each. Links found
are united to components across the passes. A window bounds what one pass sees of a dense
group, so links are then counted in full inside each component, by tiles of TILE vectors.

How much the passes find depends on how the vectors lie: inside a cluster the vectors of a pair at the threshold
part from each other nearly as fast as from the rest. So an exact check follows: all pairs of distinct vectors are compared, in pairs of tiles, and what
the passes left apart is united. Nothing is estimated from a sample. Keys are long, as in a cluster most signs say nothing.

Rules for odd input: vectors that are null, empty, zero or hold null or non-finite numbers
link with nothing; vectors of different lengths don't link; repeated rows are vectors of their
own, and rows of one id too (ties in key are sorted by row); a null id has component null unless it is linked; an empty table gives an empty
result. Labels and other columns aren't read.

Scale: passes sort keys and ids; the distinct vectors, in the precision they came in, move once a pass to the runs they are dealt to; no
pair list is made, a run sends only a spanning set of the links it found. The exact check of m distinct vectors takes m * m / 2 products, in
blocks of rows; a tile holds TILE_BYTES, and a vector is sent once for each tile. Counting links in a component of m
distinct vectors takes m * m / 2 products, as the links themselves may be so many; they are summed in tiles,
in blocks of rows, and a vector is sent to m / TILE tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.95
PASSES = 16
HASHES = 256
WINDOW = 1024
#: Windows in a run.
SPAN = 8
BLOCK = 256
TILE = 8192
#: Bytes of a tile of the exact check, and tiles at least (of WINDOW vectors, if there are so many).
TILE_BYTES = 16 << 20
LEAST_TILES = 6


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([dim, turn, 4099]).standard_normal((dim, HASHES))


def _by_length(vectors: list):
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        yield int(dim), np.flatnonzero(lengths == dim)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _sums(batches):
    """Sums of the unit vectors of a task by length: (dim, n, body)."""
    sums: dict[int, list] = {}
    for batch in batches:
        vectors = _vectors(batch.column("vec"))
        for dim, rows in _by_length(vectors):
            x, held = _unit([vectors[k] for k in rows]), sums.setdefault(dim, [0, 0.0])
            held[0], held[1] = held[0] + len(x), held[1] + x.sum(0)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))], names=["dim", "n", "total"])


def means(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length: how many distinct vectors have it, and the mean of their unit vectors. One row for each length and place."""
    parts = classes.select("vec").mapInArrow(_sums, "dim int, n long, total array<double>").select("dim", "n", F.posexplode("total").alias("k", "x"))
    out: dict[int, list] = {}
    for r in parts.groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("dim", "k").collect():
        out.setdefault(r["dim"], []).append((r["n"], r["x"]))
    return {dim: (rows[0][0], np.array([x for _, x in rows]) / rows[0][0]) for dim, rows in out.items()}


def _pack_classes(batches, kind):
    for batch in batches:
        vectors = _vectors(batch.column("vec"))
        bodies = [np.asarray(v, kind).tobytes() for v in vectors]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([len(v) for v in vectors], pa.int32()), pa.array(bodies, pa.binary())], names=["uid", "dim", "vec"])


def _keys(batches, mean: dict, turns: range, kind):
    planes: dict = {}
    for batch in batches:
        uid, dim, bodies = batch.column("uid").to_numpy(), batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            x = _unit(np.frombuffer(b"".join(bodies[k] for k in rows), kind).reshape(len(rows), d)) - mean[d]
            for turn in turns:
                if (d, turn) not in planes:
                    planes[d, turn] = _planes(int(d), turn)
                bits = np.packbits(x @ planes[d, turn] >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), turn, np.int32)), pa.array(np.full(len(rows), d, np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(uid[rows])], names=["turn", "dim", "key", "uid"])


def _spanning(ids: np.ndarray, near: np.ndarray, label: np.ndarray, out: list, rows=None, column: int = 0) -> None:
    """Adds to out the links (near: of rows, or of the first rows, by those from column on) that join groups not joined yet, and updates label in place."""
    for i in np.flatnonzero(near.any(axis=1)):
        row, j = i if rows is None else rows[i], np.flatnonzero(near[i]) + column
        j = j[label[j] != label[row]]
        if not len(j):
            continue
        groups, first = np.unique(label[j], return_index=True)
        out += [(int(ids[row]), int(ids[k])) for k in j[first]]
        label[np.isin(label, groups)] = label[row]


def _windows(batches, threshold: float, window: int, kind):
    def compare(ids, x, label, final):
        """Links of rows with the window after them; the rows whose window is not complete are kept."""
        done = len(ids) if final else max(0, len(ids) - window)
        out: list = []
        for a in range(0, done, BLOCK):
            b, end = min(a + BLOCK, done), min(a + BLOCK, done) + window
            ahead = np.arange(len(x[a:end]))[None, :] - np.arange(b - a)[:, None]
            _spanning(ids[a:end], (x[a:b] @ x[a:end].T >= threshold) & (ahead > 0) & (ahead <= window), label[a:end], out)
        return out, ids[done:], x[done:], label[done:]

    now, ids, x, label, fresh = None, None, None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        span, turn, dim, uid = (batch.column(c).to_numpy() for c in ("span", "turn", "dim", "uid"))
        bodies = batch.column("vec").to_pylist()
        edge = np.flatnonzero((np.diff(span) != 0) | (np.diff(turn) != 0) | (np.diff(dim) != 0)) + 1
        found: list = []
        for a, b in zip([0, *edge], [*edge, len(uid)]):
            run = (int(span[a]), int(turn[a]), int(dim[a]))
            y = _unit(np.frombuffer(b"".join(bodies[a:b]), kind).reshape(b - a, run[2]))
            new = np.arange(fresh, fresh + b - a)
            fresh += b - a
            if run != now:
                if now is not None:
                    found += compare(ids, x, label, True)[0]
                now, ids, x, label = run, uid[a:b], y, new
            else:
                ids, x, label = np.concatenate((ids, uid[a:b])), np.concatenate((x, y)), np.concatenate((label, new))
            if len(ids) >= 2 * window:
                more, ids, x, label = compare(ids, x, label, False)
                found += more
        if found:
            yield _edges(found)
    if now is not None and (found := compare(ids, x, label, True)[0]):
        yield _edges(found)


def _runs(sorted_keys: DataFrame, bodies: DataFrame, window: int) -> DataFrame:
    """Keys in range order (turn, dim, uid) as runs of SPAN windows, each followed by the window after it, sorted by run and place; vectors join once the places are known."""
    placed = sorted_keys.select("turn", "dim", "uid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    placed = common.materialise(placed, "sorted")
    found = sorted((r["part"], r["first"], r["n"]) for r in placed.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect())  # a row for each partition
    starts, at = [], 0
    for part, first, n in found:
        starts.append((part, at - first))
        at += n
    shift = placed.sparkSession.createDataFrame(starts, "__part int, shift long")
    ranked = placed.join(F.broadcast(shift), F.col("part") == F.col("__part")).withColumn("rank", F.col("place") + F.col("shift"))
    each = SPAN * window
    span = F.floor(F.col("rank") / F.lit(each))
    before = F.greatest(F.floor((F.col("rank") - F.lit(window)) / F.lit(each)), F.lit(0).cast("long"))
    dealt = ranked.withColumn("span", F.explode(F.sequence(before, span))).select("span", "rank", "turn", "dim", "uid")
    vectors = bodies.select(F.col("uid").alias("__uid"), "vec")
    return dealt.join(vectors, F.col("uid") == F.col("__uid")).repartition("span").sortWithinPartitions("span", "rank").select("span", "turn", "dim", "uid", "vec")


def _across(batches, threshold: float, kind):
    """Rows (dim, low, high, tile, uid, component, vec), sorted by the first three: links of components that nothing joins yet."""
    for rows in _tiles(batches):
        dim, low, high = rows[0][:3]
        first, second = ([r for r in rows if r[3] == t] for t in (low, high))
        if not first or not second:
            continue
        both = first if low == high else first + second
        x = _unit(np.frombuffer(b"".join(r[6] for r in both), kind).reshape(len(both), dim))
        ids, label = (np.array([r[c] for r in both], np.int64) for c in (4, 5))
        column, rough, found = 0 if low == high else len(first), x.astype(np.float32), []
        below = np.float32(threshold - (dim + 8) * 2e-7)  # single precision is not further off
        for a in range(0, len(first), BLOCK):
            hit = a + np.flatnonzero((rough[a : min(a + BLOCK, len(first))] @ rough[column:].T >= below).any(axis=1))
            if len(hit):
                _spanning(ids, x[hit] @ x[column:].T >= threshold, label, found, hit, column)
        if found:
            yield _edges(found)


def _all_pairs(bodies: DataFrame, of: DataFrame, sizes: dict[int, int], threshold: float, kind) -> DataFrame:
    """Links that join the components of: all pairs of one length are compared, in pairs of tiles."""
    n_tiles = {d: max(-(-n * d * 8 // TILE_BYTES), min(LEAST_TILES, -(-n // WINDOW))) for d, n in sizes.items()}
    tiles = F.create_map(*(F.lit(x) for kv in n_tiles.items() for x in kv))
    known = bodies.join(of.select(F.col("id").alias("__id"), "component"), F.col("uid") == F.col("__id"), "left").withColumn("tiles", tiles[F.col("dim")].cast("long"))
    dealt = known.withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = other.select("dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "uid", F.coalesce("component", "uid").alias("component"), "vec")
    return pairs.repartition("dim", "low", "high").sortWithinPartitions("dim", "low", "high").mapInArrow(lambda it: _across(it, threshold, kind), "a long, b long")


def _united(bodies: DataFrame, mean: dict, sizes: dict[int, int], threshold: float, kind) -> DataFrame:
    """Components of all links: of those that the passes find, and of those that join what the passes left apart. sizes: vectors of each length."""
    keyed = bodies.mapInArrow(lambda it: _keys(it, mean, range(PASSES), kind), "turn int, dim int, key binary, uid long")
    sorted_keys = keyed.repartitionByRange("turn", "dim", "key", "uid").sortWithinPartitions("turn", "dim", "key", "uid")
    found = common.materialise(_runs(sorted_keys, bodies, WINDOW).mapInArrow(lambda it, w=WINDOW: _windows(it, threshold, w, kind), "a long, b long"), "links")
    of = common.materialise(components(found), "components")
    if not sizes:
        return of
    star = of.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b")
    return common.materialise(components(star.union(common.materialise(_all_pairs(bodies, of, sizes, threshold, kind), "links"))), "components")


def _edges(found: list) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _tiles(batches) -> Iterator[list]:
    """Rows (comp, low, high, tile, uid, weight, vec), sorted by the first three, one tile pair at a time."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now and rows:
                yield rows
                rows = []
            now = row[:3]
            rows.append(row)
    if rows:
        yield rows


def _count(batches, threshold: float):
    uids, sums = [], []
    for rows in _tiles(batches):
        low, high = rows[0][1:3]
        first, second = ([r for r in rows if r[3] == t] for t in (low, high))
        if not first or not second:
            continue
        unit = lambda part: _unit(np.stack([np.frombuffer(r[6], np.float64) for r in part]))
        x, y = unit(first), unit(second)
        w1, w2 = (np.array([r[5] for r in part], np.int64) for part in (first, second))
        across = np.zeros(len(second), np.int64)
        for a in range(0, len(first), BLOCK):
            near = x[a : a + BLOCK] @ y.T >= threshold
            if low == high:
                near[np.arange(len(near)), a + np.arange(len(near))] = False
            sums += (near @ w2).tolist()
            across += w1[a : a + BLOCK] @ near
        uids += [r[4] for r in first]
        if low != high:
            uids += [r[4] for r in second]
            sums += across.tolist()
        if len(uids) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sums, pa.int64())], names=["uid", "links"])
            uids, sums = [], []
    if uids:
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sums, pa.int64())], names=["uid", "links"])


def _pack_vectors(batches):
    for batch in batches:
        bodies = [np.asarray(v, np.float64).tobytes() for v in _vectors(batch.column("vec"))]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("weight"), batch.column("component"), pa.array(bodies, pa.binary())], names=["uid", "weight", "component", "vec"])


def embedding_near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, n_links, component_id, kept, one row each."""
    e = F.col("embedding").cast("array<double>")
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(usable, F.lit(False)).alias("ok"))
    rows = rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(5), "embedding"), "row": F.monotonically_increasing_id()})
    rows = common.materialise(rows, "vectors")
    classes = rows.filter("ok").groupBy("k1", "k2").agg(F.min("row").alias("uid"), F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("vec"))
    classes = common.materialise(classes, "distinct")
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    known = means(classes)
    mean, sizes = {d: m for d, (_, m) in known.items()}, {d: n for d, (n, _) in known.items()}
    bodies = common.materialise(classes.select("uid", "vec").mapInArrow(lambda it: _pack_classes(it, kind), "uid long, dim int, vec binary"), "bodies")
    comp = _united(bodies, mean, sizes, threshold, kind)
    of = comp.select(F.col("id").alias("__id"), "component")
    members = classes.join(of, classes["uid"] == of["__id"]).select("uid", "weight", "component", "vec").mapInArrow(_pack_vectors, "uid long, weight long, component long, vec binary")
    members = common.materialise(members, "members")
    tiles = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("tiles")).withColumnRenamed("component", "__component")
    dealt = members.join(tiles, members["component"] == tiles["__component"]).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = other.select("component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "uid", "weight", "vec")
    counted = pairs.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high").mapInArrow(lambda it: _count(it, threshold), "uid long, links long")
    counted = counted.groupBy("uid").agg(F.sum("links").alias("links")).withColumnRenamed("uid", "__uid")
    whole = classes.drop("vec").join(of, F.col("uid") == F.col("__id"), "left").join(counted, F.col("uid") == F.col("__uid"), "left")
    whole = whole.withColumn("comp", F.coalesce("component", "uid"))
    least = whole.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "__comp")
    whole = whole.join(least, whole["comp"] == least["__comp"]).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id")
    out = rows.join(whole, rows["ok"] & (rows["k1"] == whole["__k1"]) & (rows["k2"] == whole["__k2"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
