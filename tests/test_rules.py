"""Rule files, one-line expressions, normalisation and validation."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spanforge.plans import diagnostics as dx
from spanforge.plans import formula as fm
from spanforge.plans.diagnostics import Diagnostic, RuleError
from spanforge.plans.dsl import parse_expression
from spanforge.plans.engine import Engine
from spanforge.plans.rules import SourceMap, parse_rules

HEAD = "rules:\n  - id: r\n    message: m\n    languages: [python]\n    severity: ERROR\n"


def formula(body: str) -> fm.Decorated:
    return Engine().compile_yaml(HEAD + body)[0].formula


def bare(d: fm.Decorated):
    """A formula without its spans."""
    kids = tuple(map(bare, d.children()))
    return type(d.node).__name__, kids or d.node, d.where, d.as_name, d.fix


def code(text: str) -> str:
    with pytest.raises(RuleError) as e:
        Engine().compile_yaml(text)
    return e.value.code


def test_legacy_normalises():
    f = formula("""    patterns:
      - pattern: foo($X)
      - pattern-not: foo(1)
      - pattern-inside: {pattern-either: [{pattern: a}, {pattern-regex: b}]}
      - pattern-not-inside: "class C: $$$B"
      - pattern-not-regex: zz
      - semgrep-internal-pattern-anywhere: g()
      - metavariable-regex: {metavariable: $X, regex: a+}
      - metavariable-pattern: {metavariable: $X, pattern: q}
      - focus-metavariable: $X
""")
    kinds = [type(b.node).__name__ for b in f.node.branches]
    assert kinds == ["Pattern", "Not", "Inside", "Not", "Not", "Anywhere"]
    assert isinstance(f.node.branches[3].node.inner.node, fm.Inside) and isinstance(f.node.branches[4].node.inner.node, fm.Regex)
    assert f.where == (fm.MetavariableRegex("$X", "a+"), fm.MetavariablePattern("$X", "q"), fm.OtherConstraint('{"focus-metavariable": "$X"}'))


def test_match_syntax_normalises_to_the_same_tree():
    a = formula("    patterns: [{pattern: a}, {pattern-not-inside: b}]\n")
    b = formula("    match: {all: [a, {not: {inside: {pattern: b}}}]}\n")
    assert bare(a) == bare(b)
    d = formula("    match: {any: [{pattern: a}, {regex: b}], as: $M, fix: q, where: [{metavariable-regex: {metavariable: $X, regex: c}}]}\n")
    assert (d.as_name, d.fix, len(d.where), type(d.node)) == ("$M", "q", 1, fm.Or)


def test_typo_in_patterns_becomes_a_constraint():
    assert formula("    patterns: [{pattern: a}, {pattern-nott: b}]\n").where == (fm.OtherConstraint('{"pattern-nott": "b"}'),)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("rules: [", dx.YAML_PARSE),
        ("- a", dx.SCHEMA_INVALID),
        ("rules: []\nextra: 1", dx.SCHEMA_INVALID),
        ("rules:\n  - id: a\n    id: b", dx.SCHEMA_INVALID),
        ("rules:\n  - message: m", dx.SCHEMA_INVALID),
        (HEAD, dx.SCHEMA_INVALID),
        (HEAD + "    pattern: a\n    match: b\n", dx.SCHEMA_INVALID),
        (HEAD + "    pattern: a\n    pattern-regex: b\n", dx.SCHEMA_INVALID),
        (HEAD + "    match: {pattern: a, regex: b}\n", dx.SCHEMA_INVALID),
        (HEAD + "    match: {nope: a}\n", dx.SCHEMA_INVALID),
        (HEAD + "    patterns: [{pattern: a}, {metavariable-regex: {metavariable: $X}}]\n", dx.SCHEMA_INVALID),
        (HEAD + "    pattern: a\n    join: {}\n", dx.SCHEMA_INVALID),
        (HEAD.replace("ERROR", "BAD") + "    pattern: a\n", dx.SCHEMA_INVALID),
        (HEAD.replace("[python]", "[]") + "    pattern: a\n", dx.SCHEMA_INVALID),
        (HEAD.replace("[python]", "[py]") + "    pattern: a\n", dx.SCHEMA_INVALID),
        (HEAD + "    mode: taint\n    pattern-sources: [a]\n    pattern-sinks: [b]\n", dx.UNSUPPORTED_MODE),
        (HEAD + "    mode: taint\n    taint: {}\n    pattern-sinks: [b]\n", dx.SCHEMA_INVALID),
        (HEAD + "    mode: join\n    join: {}\n", dx.UNSUPPORTED_MODE),
        (HEAD + "    mode: extract\n    pattern: a\n    extract: b\n", dx.SCHEMA_INVALID),
        (HEAD + "    mode: extract\n    pattern: a\n    extract: b\n    dest-language: go\n", dx.UNSUPPORTED_MODE),
        (HEAD + "    mode: novel\n    pattern: a\n", dx.UNSUPPORTED_MODE),
        (HEAD + "    pattern-either: [{pattern: a}, {pattern-not: b}]\n", dx.INVALID_NOT_IN_OR),
        (HEAD + "    pattern-either: [{patterns: [{pattern: a}, {pattern-not: b}]}]\n", dx.INVALID_NOT_IN_OR),
        (HEAD + "    patterns: [{pattern-not: a}]\n", dx.MISSING_POSITIVE_TERM),
        (HEAD + "    patterns: []\n", dx.MISSING_POSITIVE_TERM),
        (HEAD + "    pattern-regex: '('\n", dx.SCHEMA_INVALID),
        (HEAD + "    patterns: [{pattern: a}, {metavariable-regex: {metavariable: $X, regex: '['}}]\n", dx.SCHEMA_INVALID),
        (HEAD + "    r2c-internal-project-depends-on: {namespace: pypi}\n", dx.SCHEMA_INVALID),
    ],
)
def test_diagnostics(text, want):
    assert code(text) == want


def test_rules_by_language_and_versions():
    text = HEAD.replace("[python]", "[python, rust]") + "    pattern: a\n    min-version: 1.0.0\n    unknown-key: kept out\n"
    assert [(p.rule_id, p.language) for p in Engine().compile_yaml(text)] == [("r", "python"), ("r", "rust")]
    assert parse_rules(text)[0].min_version == "1.0.0"


def test_top_level_negation_passes_and_dependencies_never_match(spark):
    assert isinstance(formula("    match: {not: a}\n").node, fm.Not)
    plan = Engine().compile_yaml(HEAD + "    r2c-internal-project-depends-on: {namespace: pypi, package: x}\n")
    src = spark.createDataFrame([("u", "x = 1\n")], "uri string, text string")
    assert Engine().execute(plan, src).count() == 0


def test_source_map_counts_bytes():
    text = "# é\nrules:\n  - id: ü\n    mode: search\n"
    m = SourceMap.parse(text, "f.yaml")
    s = m.fields[0]["mode"]
    assert text.encode()[s.start : s.end] == b"search" and s.uri == "f.yaml"


def test_diagnostics_round_trip():
    with pytest.raises(RuleError) as e:
        parse_rules("rules:\n  - message: m")
    d = json.loads(e.value.to_json())[0]
    assert Diagnostic.from_dict(d) == e.value.diagnostics[0]
    assert Diagnostic.from_dict({"code": "c", "message": "m", "span": {"start": 1, "end": 2}}).primary_span.end == 2


def test_depth_limit():
    f = fm.bare(fm.Regex("a"))
    for _ in range(999):
        f = fm.bare(fm.Inside(f))
    fm.validate(f)
    with pytest.raises(RuleError) as e:
        fm.validate(fm.bare(fm.Inside(f)))
    assert e.value.code == dx.SCHEMA_INVALID


def test_expressions():
    f = parse_expression('pattern("a") and not inside(regex(r"\\d")) and regex("b") or ts("(x) @y") # note')
    assert isinstance(f.node, fm.Or) and isinstance(f.node.branches[0].node, fm.And)
    assert len(f.node.branches[0].node.branches) == 3
    g = parse_expression('all(pattern("a"), pattern-not-regex("b")) where { metavariable-regex("$X", "c"), focus("$X") } as "$M" fix "q"')
    assert len(g.where) == 2 and g.as_name == "$M" and g.fix == "q"
    for bad in ('pattern("a"', "pattern(a)", "and", 'pattern("a") pattern("b")', 'regex("a") where { x }', "%"):
        with pytest.raises(RuleError) as e:
            parse_expression(bad)
        assert e.value.code == dx.DSL_PARSE


trees = st.recursive(
    st.sampled_from([fm.Pattern("p"), fm.Regex("r"), fm.TreeQuery("(a)")]).map(fm.bare),
    lambda t: st.one_of(
        t.map(lambda x: fm.bare(fm.Not(x))), t.map(lambda x: fm.bare(fm.Inside(x))), t.map(lambda x: fm.bare(fm.Anywhere(x))),
        st.lists(t, max_size=3).map(lambda x: fm.bare(fm.And(tuple(x)))), st.lists(t, max_size=3).map(lambda x: fm.bare(fm.Or(tuple(x)))),
    ),
    max_leaves=12,
)


@given(trees)
def test_validation_agrees_with_a_plain_reading(tree):
    def has_not(d):
        return isinstance(d.node, fm.Not) or any(map(has_not, d.children()))

    every = list(tree.walk())
    in_or = any(isinstance(d.node, fm.Or) and any(map(has_not, d.children())) for d in every)
    lacking = any(isinstance(d.node, fm.And) and not fm.is_positive(d) for d in every)
    want = dx.INVALID_NOT_IN_OR if in_or else dx.MISSING_POSITIVE_TERM if lacking else None
    try:
        fm.validate(tree)
        got = None
    except RuleError as e:
        got = e.code
    assert got == want
