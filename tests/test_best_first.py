import heapq
import math
import random

import pytest

from spanforge.operators import best_first
from spanforge.operators.slices import SliceRequest

W = best_first.WEIGHTS


def plain(edges, nodes, entry, q):
    """One slice by a heap: kept ids in order, and what is spilled."""
    steps, fan = {}, {}
    for a, b, c in edges:
        if c < q.min_confidence:
            continue
        fan[b] = fan.get(b, 0) + 1
        for way, x, y in (("out", a, b), ("in", b, a)):
            if q.direction in (way, "both"):
                steps.setdefault(x, {})[y] = max(c, steps.get(x, {}).get(y, 0))
    cost, module = (lambda x: nodes.get(x, (0, None))[0]), (lambda x: nodes.get(x, (0, None))[1])
    kept, seen, spent, spilled, heap, pushed = [entry], {module(entry)}, cost(entry), set(), [], set()

    def push(x, depth):
        for y, c in steps.get(x, {}).items():
            new = W["novelty"] if module(y) is not None and module(y) not in seen else 0.0
            score = W["confidence"] * c + W["fan_in"] * math.log1p(fan.get(y, 0)) + W["cost"] * cost(y) + W["proximity"] / depth + new
            pushed.add(y)
            heapq.heappush(heap, (-score, y, depth))

    if q.depth > 0:
        push(entry, 1)
    while heap and len(kept) <= min(q.max_cards - 1, q.max_edges):
        if len(kept) == min(q.max_cards - 1, q.max_edges) + 1:
            break
        _, y, depth = heapq.heappop(heap)
        if y in kept or y in spilled:
            continue
        if spent + cost(y) > q.max_tokens:
            spilled.add(y)
            continue
        kept.append(y)
        spent += cost(y)
        seen.add(module(y))
        if depth < q.depth:
            push(y, depth + 1)
    return kept, pushed - set(kept)


@pytest.mark.parametrize("change", [{}, {"direction": "out", "depth": 3, "max_cards": 6}, {"direction": "in", "max_tokens": 400}, {"depth": 0}, {"max_edges": 2}])
def test_slices_equal_a_heap(spark, change):
    """1,000 entries in one plan; scores are apart by rounding at least."""
    r = random.Random(3)
    ids = [f"n{k}" for k in range(300)]
    edges = [(r.choice(ids), r.choice(ids[:40] if k % 3 else ids), r.random()) for k in range(1500)] + [("loop", "loop", 0.9)]
    nodes = {x: (r.randrange(20, 200), r.choice(["a", "b", "c", None])) for x in ids[:-5]}
    q = SliceRequest("", 1, 1, **{"max_cards": 12, "max_tokens": 900, **change})
    n = 1000 if not change else 60
    entries = [(f"s{k}", ids[k % 300]) for k in range(n)] + [("self", "loop"), ("alone", "nowhere")]
    frames = [spark.createDataFrame(x, s) for x, s in ((edges, "caller string, callee string, confidence double"), ([(k, *v) for k, v in nodes.items()], "id string, tokens long, module string"), (entries + [entries[0], ("null", None)], "slice_id string, id string"))]
    got = {}
    for x in best_first.best_first_slices(*frames, q).collect():
        got.setdefault(x.slice_id, []).append(x)
    assert set(got) == {s for s, _ in entries}
    for s, entry in entries[-62:] + entries[:240]:
        kept, spilled = plain(edges, nodes, entry, q)
        rows = got[s]
        assert [x.id for x in sorted((x for x in rows if x.kept), key=lambda x: x.place)] == kept
        assert {x.id for x in rows if not x.kept} == spilled and len(rows) == len(kept) + len(spilled)


def test_rounds_neither_aggregate_nor_shuffle_all_steps(spark, monkeypatch):
    """What the steps of a symbol bring is aggregated once, not in each round, and a round joins the steps of what it took only."""
    plans, write = [], best_first.materialise

    def told(df, name, by=None):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, by)

    monkeypatch.setattr(best_first, "materialise", told)
    edges = spark.createDataFrame([(f"n{k}", f"n{k + d}", 0.5) for k in range(30) for d in (1, 2, 3)], "caller string, callee string, confidence double")
    nodes = spark.createDataFrame([(f"n{k}", 5, f"m{k % 4}") for k in range(40)], "id string, tokens long, module string")
    entries = spark.createDataFrame([("s", "n0"), ("t", "n7")], "slice_id string, id string")
    best_first.best_first_slices(edges, nodes, entries, SliceRequest("", 1, 1, direction="out", max_cards=4)).collect()
    rounds = [plan for name, plan in plans if name == "round"]
    assert rounds and not any("max(merit" in plan for plan in rounds)
    pools = [plan for name, plan in plans if name == "pool"]
    assert pools and all("LeftSemi" in plan for plan in pools)
    steps = spark.createDataFrame([(f"n{k}", "x") for k in range(1000)], "at string, to string")
    kept = {r["at"] for r in best_first._flagged(steps, entries).collect()}
    assert {"n0", "n7"} <= kept and len(kept) < 10
