"""Trees, structural patterns, rewriting, formula execution."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators import lowering, matcher, rewrite, spans, tree_query
from spanforge.plans.diagnostics import RuleError
from spanforge.plans.engine import Engine, EngineConfig
from spanforge.sources import trees

PY = '''import os

@cached(1)
def greet(name: str, n=2) -> str:
    print("hello")
    x = foo(name, n)
    if x:
        print(name, x)
    return x

class A(B):
    def m(self):
        print("ü"); print("z")
'''


def find(pattern, text=PY, language="python", **kw):
    c = matcher.compile_pattern(pattern, language, **kw)
    tree = trees.parse(text, language)
    return [(tree.source[m.start : m.end].decode(), {k: v.text for k, v in m.captures.items()}) for m in matcher.find_all(c, tree)]


def test_print_calls_capture_their_parentheses():
    got = find("print($$$ARGS)")
    assert [g[1]["ARGS"] for g in got] == ['("hello")', "(name, x)", '("ü")', '("z")']


def test_unification_and_wildcards():
    text = "f(a, a)\nf(a, b)\nf(a, b, c)\n"
    assert [g[0] for g in find("f($X, $X)", text)] == ["f(a, a)"]
    assert [g[0] for g in find("f($_, $_)", text)] == ["f(a, a)", "f(a, b)"]
    assert [g[1] for g in find("f($X, $$$R)", text)] == [{"X": "a", "R": "a"}, {"X": "a", "R": "b"}, {"X": "a", "R": "b, c"}]


def test_extended_dialect():
    assert len(find("print(...)")) == 4
    assert find("if $C: <... print($X, $Y) ...>") == [("if x:\n        print(name, x)", {"C": "x", "X": "name", "Y": "x"})]
    assert find("foo($...ALL)")[0][1]["ALL"] == "name, n"


def test_other_languages():
    rs = 'fn main() { let a = 1; println!("x {}", a); foo(a, b); foo(a, a); }'
    assert [g[0] for g in find("foo($X, $X)", rs, "rust")] == ["foo(a, a)"]
    assert find("println!($$$A);", rs, "rust")[0][1]["A"] == '("x {}", a)'
    assert len(find("console.log($$$A)", "function f() { console.log(1, 2) }\nconsole.log('t')\n", "typescript")) == 2
    assert find('<a href="x">$T</a>', '<p><a href="x">hi</a><a href="y">yo</a></p>', "html") == [('<a href="x">hi</a>', {"T": "hi"})]


@pytest.mark.parametrize("bad", ["$", "$$X", "$$$$X", "f($)", "def (", "a\nb", "<... x"])
def test_bad_patterns(bad):
    with pytest.raises(RuleError) as e:
        matcher.compile_pattern(bad, "python")
    assert e.value.code == "E_PATTERN_SNIPPET_PARSE_FAILED"


def test_runs_do_not_explode():
    text = "f(" + ", ".join("a" * 1 for _ in range(60)) + ")\n"
    assert find("f($$$A, x, $$$B, y, $$$C, z)", text) == []


def test_find_first_and_positions(spark):
    src = spark.createDataFrame([("a.py", PY), ("b.py", "pass\n"), ("c.py", None)], "uri string, text string")
    got = matcher.match_sources(src, "print($$$A)", "python", first_only=True).collect()
    assert [(r.uri, r.start_line, r.start_column) for r in got] == [("a.py", 5, 5)]


def test_nodes_are_intervals(spark):
    rows = trees.nodes(spark.createDataFrame([("u", PY)], "uri string, text string"), "python").collect()
    by = {r.node_id: r for r in rows}
    assert len(by) == len(rows) and all(r.subtree_last_id >= r.node_id for r in rows)
    for r in rows:
        if r.parent_id is not None:
            p = by[r.parent_id]
            assert p.node_id < r.node_id <= p.subtree_last_id and p.start_byte <= r.start_byte and r.end_byte <= p.end_byte


@pytest.mark.parametrize(("language", "text"), [("python", "def f(:\n"), ("rust", "fn f( { }"), ("typescript", "f(]"), ("html", "<p></b></p>")])
def test_errors_are_nodes(language, text):
    assert trees.parse(text, language).has_errors()


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab(){}[];'\"\n <>/=.:é!#")), max_size=60))
def test_providers_cover_any_text(text):
    for language in trees.PROVIDERS:
        tree = trees.parse(text, language)
        for n in tree.root.walk():
            assert 0 <= n.start <= n.end <= len(tree.source)


def test_rewriting():
    rule = rewrite.RewriteRule("print($$$A)", "log$$$A", "python")
    text, n = rewrite.rewrite_text('print("a")\nprint(1)\n', rule.check(), rule.replacement)
    assert (text, n) == ('log("a")\nlog(1)\n', 2)
    with pytest.raises(RuleError):
        rewrite.RewriteRule("f($X)", "g($Y)", "python").check()
    assert rewrite.substitute("$X $$X $_ $Y $$$Z $", {"X": "1"}) == "1 $$X  $Y  $"
    nested = rewrite.rewrite_text("<b><b>x</b></b>", matcher.compile_pattern("<b>$X</b>", "html"), "[$X]")
    assert nested == ("[<b>x</b>]", 2)


def test_tree_queries():
    tree = trees.parse(PY, "python")
    q = tree_query.compile_query('(call (identifier) @f (#match? @f "^pr")) @call')
    assert len(list(tree_query.find(q, tree))) == 4
    for bad in ("(", "(a", "x y", "(a) (b)", "(#foo? @a b)"):
        with pytest.raises(RuleError) as e:
            tree_query.compile_query(bad)
        assert e.value.code == "E_TREE_QUERY_INVALID"


# -- span sweeps and formulas ----------------------------------------------------------

some_spans = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12), st.integers(0, 5)), max_size=8)


@settings(max_examples=12, deadline=None)
@given(some_spans, some_spans)
def test_sweeps_agree_with_nested_loops(spark, left, right):
    schema = "uri string, start_byte long, end_byte long, k int"
    rows = lambda xs: [(u, s, s + n + 1, k) for k, (u, s, n) in enumerate(xs)]
    a, b = spark.createDataFrame(rows(left), schema), spark.createDataFrame(rows(right), schema)
    inside = lambda x: any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] for y in rows(right))
    over = lambda x: any(y[0] == x[0] and y[1] < x[2] and x[1] < y[2] for y in rows(right))
    for f, test in ((spans.contained, inside), (spans.overlapping, over)):
        assert sorted(map(tuple, f(a, b).collect())) == sorted(filter(test, rows(left)))
        assert sorted(map(tuple, f(a, b, negate=True).collect())) == sorted(x for x in rows(left) if not test(x))


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a.py", PY, "python"), ("b.py", "foo(q, q)\nfoo(q, r)\nbar(r)\n", "python"), ("n.py", None, "python")], "uri string, text string, lang string")


def run(sources, expression, **kw):
    plan = Engine().compile_dsl("r", "python", expression)
    return Engine(EngineConfig(**kw)).execute(plan, sources).orderBy("uri", "start_byte").collect()


def test_formula_execution(sources):
    texts = lambda e, **kw: [r.text for r in run(sources, e, **kw)]
    assert texts('pattern("print($$$A)") and inside(pattern("class $C($$$B): $$$D"))') == ['print("ü")', 'print("z")']
    assert texts('pattern("print($$$A)") and not inside(pattern("class $C($$$B): $$$D"))') == ['print("hello")', "print(name, x)"]
    assert texts('pattern("foo($X, $Y)") and not pattern("foo($X, $X)")') == ["foo(name, n)", "foo(q, r)"]
    assert texts('pattern("foo($X, $Y)") and anywhere(regex("bar"))') == ["foo(q, q)", "foo(q, r)"]
    assert texts('pattern("foo($X, $Y)") and pattern("bar($Y)")') == ["foo(q, r)"]
    assert texts('pattern("foo($X, $Y)") where { metavariable-regex("$X", "q$"), metavariable-regex("$Y", "r") }') == ["foo(q, r)"]
    assert texts('pattern("foo($X, $Y)") or pattern("foo($X, $X)")') == ["foo(name, n)", "foo(q, q)", "foo(q, q)", "foo(q, r)"]
    assert texts('pattern("foo($X, $Y)") or pattern("foo($X, $Y)")') == ["foo(name, n)", "foo(q, q)", "foo(q, r)"]
    assert texts('not pattern("foo($X)")') == []
    assert texts('pattern("print($$$A)")', max_matches_per_rule=2) == ['print("hello")', "print(name, x)"]


def test_captures_focus_and_names(sources):
    row = run(sources, 'regex("foo\\\\((?P<A>q), (r)") as "$ALL" fix "new"')[0]
    assert [(c.name, c.text) for c in row.captures] == [("$1", "q"), ("$2", "r"), ("$A", "q"), ("$ALL", "foo(q, r")] and row.fix == "new"
    focus = run(sources, 'pattern("foo($X, $Y)") where { metavariable-comparison("$X == \'q\'"), focus("$Y") }')
    assert [(r.start_byte, r.end_byte) for r in focus] == [(7, 8), (17, 18)]
    inside = run(sources, 'pattern("foo($$$ARGS)") where { metavariable-pattern("$ARGS", "name") }', max_capture_text_bytes=3)
    assert all(c.text is None for r in inside for c in r.captures)
    deep = 'pattern("if $C: <... print($X, $Y) ...>")'
    assert len(run(sources, deep)) == 1 and run(sources, deep, max_deep_search_nodes=1) == []
    with pytest.raises(RuleError) as e:
        run(sources, 'pattern("foo($X)") where { metavariable-type("$X") }')
    assert e.value.code == "E_UNSUPPORTED_CONSTRAINT"


def test_regex_spans_count_bytes(spark):
    src = spark.createDataFrame([("u", "aé\nbéé x")], "uri string, text string")
    got = lowering.regex_spans(src, "b(é+)").collect()[0]
    assert (got.start_byte, got.end_byte, got.captures[0].start_byte, got.captures[0].end_byte) == (4, 9, 5, 9)


def test_constraint_regexes_speak_the_dialect_that_is_checked(spark):
    """Named groups in Python's spelling pass the check and run."""
    sources = spark.createDataFrame([("u", "ab12 cd")], "uri string, text string")
    assert len(run(sources, r'regex("(?P<W>[a-z]+[0-9]*)") where { metavariable-regex("$W", "(?P<x>[a-z])b") }')) == 1


def test_first_match_within_a_budget():
    tree = trees.parse("if a:\n    print(1, 2)\n", "python")
    compiled = matcher.compile_pattern("if $C: <... print($X, $Y) ...>", "python", True)
    assert matcher.find_first(compiled, tree) is not None and matcher.find_first(compiled, tree, 1) is None
