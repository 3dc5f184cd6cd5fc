"""Lowered formulas against a plain evaluator."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators import lowering
from spanforge.plans import formula as fm
from spanforge.plans.engine import Engine, EngineConfig

ATOMS = ["a+", "b", "ab", "c[ab]*", "(?m)^[^\n]*", "a[^\n]*b"]
atom = st.sampled_from(ATOMS).map(lambda p: fm.bare(fm.Regex(p)))
inner = st.one_of(atom, st.lists(atom, min_size=1, max_size=2).map(lambda x: fm.bare(fm.Or(tuple(x)))))
term = st.one_of(
    inner.map(lambda x: fm.bare(fm.Inside(x))), inner.map(lambda x: fm.bare(fm.Anywhere(x))), inner.map(lambda x: fm.bare(fm.Not(x))),
    inner.map(lambda x: fm.bare(fm.Not(fm.bare(fm.Inside(x))))), inner.map(lambda x: fm.bare(fm.Not(fm.bare(fm.Anywhere(x))))), atom,
)
formulas = st.tuples(inner, st.lists(term, max_size=3)).map(lambda x: fm.bare(fm.And((x[0], *x[1]))))
texts = st.lists(st.text("abc\n", max_size=12), min_size=1, max_size=4)


def evaluate(d: fm.Decorated, text: str) -> set[tuple[int, int]]:
    """Spans of a formula without captures in one file."""
    n = d.node
    if isinstance(n, fm.Regex):
        return {m.span() for m in re.finditer(n.pattern, text)}
    if isinstance(n, fm.Or):
        return set().union(*(evaluate(b, text) for b in n.branches))
    if not isinstance(n, fm.And):
        return set()
    positive = [b for b in n.branches if fm.is_positive(b)]
    out = evaluate(positive[0], text)
    for b in positive[1:]:
        out = out if evaluate(b, text) else set()
    within = lambda x, y: y[0] <= x[0] and x[1] <= y[1]
    cross = lambda x, y: y[0] < x[1] and x[0] < y[1]
    for b in n.branches:
        inside = b.node.inner if isinstance(b.node, fm.Not) else b
        negate = isinstance(b.node, fm.Not)
        if isinstance(inside.node, fm.Inside):
            other = evaluate(inside.node.inner, text)
            out = {x for x in out if any(within(x, y) for y in other) != negate}
        elif isinstance(inside.node, fm.Anywhere):
            out = out if bool(evaluate(inside.node.inner, text)) != negate else set()
        elif negate:
            other = evaluate(inside, text)
            out = {x for x in out if not any(cross(x, y) for y in other)}
    return out


@settings(max_examples=12, deadline=None)
@given(formulas, texts)
def test_lowering_agrees_with_a_plain_evaluator(spark, formula, files):
    src = spark.createDataFrame([(str(k), t) for k, t in enumerate(files)], "uri string, text string")
    got = {(r.uri, r.start_byte, r.end_byte) for r in lowering.lower(formula, src, "prose").collect()}
    assert got == {(str(k), s, e) for k, t in enumerate(files) for s, e in evaluate(formula, t)}


def test_all_atoms_in_one_pass(spark):
    """Plans that share files read them once: one scan of the sources, whatever the number of atoms."""
    engine = Engine()
    plans = [engine.compile_dsl(f"r{k}", "prose", f'regex("a{k}") and not regex("b{k}")') for k in range(3)] + [engine.compile_dsl("p", "prose", 'pattern("$A of $B")')]
    rows = [("u", "a0 a1 b1. one of two"), ("v", "a2"), ("w", None)]
    sources = spark.createDataFrame(rows, "uri string, text string")
    together = engine.execute(plans, sources)
    alone = [r for p in plans for r in lowering.lower(p.formula, sources, "prose").collect()]
    assert sorted((r.uri, r.start_byte, r.end_byte) for r in together.collect()) == sorted((r.uri, r.start_byte, r.end_byte) for r in alone)
    assert "MapInArrow" not in together._jdf.queryExecution().executedPlan().toString()
    plan = Engine(EngineConfig(max_matches_per_rule=None)).execute(plans, sources)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "atom" in plan


def test_files_without_a_patterns_words_are_not_read(spark):
    """The words are looked for by a filter before any Python; results are the same."""
    from spanforge.operators import matcher

    compiled = matcher.compile_pattern("use($X, make(1), $$$R)", "python")
    assert compiled.needs == ["make", "use"] and matcher.compile_pattern("$X", "python").needs == []
    rows = [(f"f{k}.py", ["use(a, make(1), b)\n", "use(a)\n", "x = 1\n", None, "# use make\n", "use(a, make( 1 ), c, d)\n"][k % 6]) for k in range(60)]
    sources = spark.createDataFrame(rows, "uri string, text string")
    found = matcher.match_sources(sources, "use($X, make(1), $$$R)", "python")
    assert sorted(r.uri for r in found.collect()) == sorted(u for k, (u, _) in enumerate(rows) if k % 6 in (0, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Contains")
