import itertools
import random

import numpy as np
import pytest

from spanforge.operators import history
from spanforge.sources import storage

SYMBOLS = "symbol_id string, kind string, name string, container string, signature string, body string, doc string, structure array<string>"
CALLS = "caller string, callee string"
WEIGHT = history.FEATURE_WEIGHTS


def similarity(x, y):
    shared, union = set(x) & set(y), set(x) | set(y)
    return sum(WEIGHT[f[0]] for f in shared) / sum(WEIGHT[f[0]] for f in union)


def test_similarity_join_loses_nothing_at_20_000_sets(spark):
    r = random.Random(4)
    common = [f"{t}:{k}" for t in "nsbcd" for k in range(6)]
    bases = [[f"{r.choice('nsbcd')}:{r.randrange(30_000)}" for _ in range(r.randrange(1, 12))] for _ in range(6000)]

    def near(base):
        kept = [f for f in base if r.random() < 0.8]
        return sorted({*kept, *r.sample(common, 3), *(f"b:x{r.randrange(10**6)}" for _ in range(r.randrange(3)))})

    rows = {side: [(f"k{k % 2}" if k % 7 else None, f"{side}{k}", near(bases[k % 6000])) for k in range(10_000)] for side in "ba"}
    frames = {side: spark.createDataFrame(rows[side] + [(None, f"{side}-none", [])], "kind string, set_id string, features array<string>") for side in "ba"}
    got = {(x.b_set, x.a_set): x.similarity for x in history.similar_sets(frames["b"], frames["a"], 0.35).collect()}
    index = {}
    for kind, a, fs in rows["a"]:
        for f in fs:
            index.setdefault((kind, f), []).append((a, fs))
    want = {}
    for kind, b, fs in rows["b"]:
        for a, other in {a: o for f in fs if f not in common for a, o in index.get((kind, f), [])}.items():
            if (s := similarity(fs, other)) >= 0.35:
                want[b, a] = s
    # sets that share frequent features only
    small = {side: [x for x in rows[side] if len(x[2]) <= 8] for side in "ba"}
    for kind, b, fs in small["b"][:400]:
        for k2, a, other in small["a"]:
            if kind == k2 and (s := similarity(fs, other)) >= 0.35:
                assert got[b, a] == pytest.approx(s)
    assert all(got[p] == pytest.approx(s) for p, s in want.items()) and len(want) > 5000
    assert all(s >= 0.35 for s in got.values())


def best_total(gains):
    n, m = gains.shape
    wide = np.concatenate((gains, np.zeros((n, n))), axis=1)
    return max(sum(max(wide[i, j], 0) for i, j in enumerate(p)) for p in itertools.permutations(range(m + n), n))


def test_local_assignment_is_best():
    r = np.random.default_rng(1)
    for _ in range(120):
        n, m = r.integers(1, 5), r.integers(1, 4)
        gains = r.integers(-3, 6, (n, m)).astype(float)
        found = history.best_assignment(gains)
        taken = [j for j in found if j >= 0]
        assert len(taken) == len(set(taken))
        assert sum(gains[i, j] for i, j in enumerate(found) if j >= 0) == best_total(gains)


@pytest.mark.parametrize("exact", [256, 0])
def test_assignment_is_one_to_one_and_best(spark, exact):
    """Exactly in a task, and by the auction over all tasks."""
    r = random.Random(9)
    groups = [[(f"b{g}-{i}", f"a{g}-{j}", round(r.uniform(0.4, 0.99), 3)) for i in range(3) for j in range(3) if r.random() < 0.8] for g in range(12)]
    groups.append([(f"b99-{i}", f"a99-{j}", 0.9) for i in range(3) for j in range(2)])  # copies
    pairs = spark.createDataFrame([p for g in groups for p in g], "before_id string, after_id string, probability double")
    found = {(x.before_id, x.after_id) for x in history.assign(pairs, exact=exact, step=1 if exact else 30_000).collect()}
    assert len({b for b, _ in found}) == len({a for _, a in found}) == len(found)
    for g in groups:
        left, right = sorted({b for b, _, _ in g}), sorted({a for _, a, _ in g})
        gains = np.zeros((len(left), len(right)))
        for b, a, p in g:
            gains[left.index(b), right.index(a)] = max(0.0, np.log(p / 0.5))
        got = sum(np.log(p / 0.5) for b, a, p in g if (b, a) in found)
        assert got == pytest.approx(best_total(gains), abs=1e-5 if exact else len(left) * 0.03 + 1e-5)


def test_groups_over_long_chains(spark):
    chain = [(f"b{k:02d}", f"a{k + d:02d}") for k in range(40) for d in (0, 1)] + [("z", "y")]
    got = {x.before_id: x.group for x in history.groups_of(spark.createDataFrame(chain, "before_id string, after_id string")).collect()}
    assert {got[f"b{k:02d}"] for k in range(40)} == {"b00"} and got["z"] == "z"


def symbol(i, name, body="", kind="function", container="m", signature=None, doc=None, structure=None):
    return (i, kind, name, container, signature, body, doc, structure)


def test_tracking_by_phases_and_neighbours(spark):
    """Five functions of one name: the calls around them tell which is which."""
    before = [symbol(f"f{k}", "foo", f"do thing {k % 2}", container=f"c{k}") for k in range(5)] + [symbol(f"g{k}", f"bar{k}", f"only {k}") for k in range(5)]
    after = [symbol(f"F{k}", "qux", f"do thing {k % 2} now", container=f"d{k}") for k in range(5)] + [symbol(f"G{k}", f"bar{k}", f"only {k} else") for k in range(5)]
    before += [symbol("r", "old", "a b old c"), symbol("gone", "zip", "nothing left of it"), symbol("n", None, None, kind=None)]
    after += [symbol("R", "new", "a  b new c"), symbol("fresh", "zap", "all other words here"), symbol("N", None, None, kind=None)]
    calls = [(f"f{k}", f"g{k}") for k in range(5)]
    frames = [spark.createDataFrame(x, SYMBOLS) for x in (before, after)]
    edges = [spark.createDataFrame(x, CALLS) for x in (calls, [(a.upper(), b.upper()) for a, b in calls])]
    rows = history.track(*frames, *edges, threshold=0.2).collect()
    got = {x.before_id: (x.after_id, x.outcome, x.phase) for x in rows}
    assert all(got[f"f{k}"] == (f"F{k}", "matched", 5) and got[f"g{k}"] == (f"G{k}", "matched", 1) for k in range(5))
    assert got["r"] == ("R", "matched", 2) and got["gone"] == (None, "deleted", None)
    assert got["n"][0] == "N"  # nulls are equal to nulls
    assert [x.after_id for x in rows if x.outcome == "created"] == ["fresh"]
    assert len([x for x in rows if x.before_id]) == len(before) and len([x for x in rows if x.after_id]) == len(after)


def test_crowds_are_ambiguous(spark):
    many = [spark.createDataFrame([symbol(f"{c}{k}", "same", "twin body text") for k in range(6)] + [symbol(f"{c}x", "other", "x y z")], SYMBOLS) for c in "ba"]
    none = spark.createDataFrame([], CALLS)
    rows = history.track(*many, none, none, max_duplicates=5).collect()
    assert sum(x.outcome == "ambiguous" for x in rows) == 12 and [(x.before_id, x.after_id) for x in rows if x.outcome == "matched"] == [("bx", "ax")]
    rows = history.track(*many, none, none, max_duplicates=6).collect()
    assert sum(x.outcome == "matched" for x in rows) == 7 and len({x.after_id for x in rows}) == 7
    empty = spark.createDataFrame([], SYMBOLS)
    assert history.track(empty, empty, none, none).collect() == []


def test_tables_are_dropped(spark):
    with storage.temporary_tables(spark):
        kept = storage.materialise(spark.range(3), "scope")
        path = storage._PATHS[-1].removeprefix("file://")
        assert kept.count() == 3
        import os

        assert os.path.exists(path)
    assert not os.path.exists(path) and path not in storage._PATHS


def test_paths_are_counted(spark):
    from spanforge.operators import graph

    edges = [("r", "a"), ("r", "b"), ("a", "z"), ("b", "z"), ("z", "y"), ("y", "z"), ("a", "z")]
    found = graph.path_edges(spark.createDataFrame(edges, CALLS), spark.createDataFrame([("r",), ("r",)], "id string"), 5, True).collect()
    got = {(x.caller, x.callee, x.depth): int(x.paths) for x in found}
    assert got["r", "a", 1] == 1 and got["a", "z", 2] == 2 and got["b", "z", 2] == 1 and got["z", "y", 3] == 3 and got["y", "z", 4] == 3 and got["z", "y", 5] == 3
    up = graph.path_edges(spark.createDataFrame(edges, CALLS), spark.createDataFrame([("y",)], "id string"), 3, False).collect()
    assert {(x.caller, x.callee): int(x.paths) for x in up if x.depth == 3} == {("r", "a"): 2, ("r", "b"): 1, ("z", "y"): 1}
    assert graph.path_edges(spark.createDataFrame(edges, CALLS), spark.createDataFrame([("y",)], "id string"), 0, False).count() == 0


def test_cap_sorts_only_rules_beyond_it(spark):
    from spanforge.operators import lowering

    rows = [(rule, f"u{k % 7}", k, k + 1) for rule, n in (("big", 500), ("small", 5), ("even", 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "rule_id string, uri string, start_byte long, end_byte long").repartition(5)
    capped = lowering.cap(df, 20)
    want = [r for rule in ("big", "small", "even") for r in sorted(x for x in rows if x[0] == rule)[:20]]
    assert sorted(map(tuple, capped.collect())) == sorted(want)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert sorted(map(tuple, lowering.cap(df, 500).collect())) == sorted(rows)


def test_suggestions_by_deletions(spark):
    """As comparing all pairs, with no nested loop in the plan."""
    from spanforge.functions import text as tx

    r = random.Random(2)
    names = ["".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(150)] + ["zz", "zz"]
    words = ["".join(r.choice("abc") for _ in range(r.randrange(8))) for _ in range(80)] + ["zzy", "", None, "qqqqqq", "ab", "ab"]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def nearest(w, most):
        near = sorted((edits(w, n), n) for n in names if edits(w, n) <= most) if w is not None else []
        return near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else None

    for most in (0, 1, 2, 3):
        found = tx.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names], "name string"), most)
        assert {x.word: x.suggestion for x in found.collect()} == {w: nearest(w, most) for w in words}
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_single_pairs_are_assigned_without_a_solver(spark, monkeypatch):
    def never(frame):
        raise AssertionError("called for a pair that competes with no other")

    monkeypatch.setattr(history, "_solve_group", never)
    pairs = [(f"b{k}", f"a{k}", 0.9) for k in range(50)] + [("b99", "a99", 0.4)]
    got = history.assign(spark.createDataFrame(pairs, "before_id string, after_id string, probability double")).collect()
    assert sorted((r["before_id"], r["after_id"]) for r in got) == sorted((b, a) for b, a, p in pairs if p > 0.5)
