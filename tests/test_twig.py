"""Queries over stored node tables, against the matcher over trees and against plain ancestor walks."""

import random

import pytest

from spanforge.operators import lowering, tree_query, twig
from spanforge.sources import trees

QUERIES = [
    '(element (start_tag (tag_name) @t) (#eq? @t "b"))',
    '(element (start_tag (tag_name) @t) (text) @x (#match? @x "^[a-zé]+$")) @e',
    "(element (text) (element) (text)) @e",
    "(element (start_tag) (element) @a (text) (element) @b)",
    "(element (element (element) (text)) (text) (element) (_))",
    "(element (element) @x (element) @x (#not-eq? @x \"<i>é</i>\"))",
    "(_ (_) @k (end_tag)) @p",
    '(element "é" @leaf)',
    '(element (start_tag (tag_name) @s) (element (start_tag (tag_name) @s2)) (#eq? @s @s2))',
    '(element (text) @x (#not-match? @x "\\w"))',
    "(document)",
    "(element (text) @a @b)",
    '(element (text) @x (#eq? @x @unknown))',
]


def _html(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 5)):
        tag = r.choice("bip")
        out.append(r.choice(["é", "ab", "x y", "", "<br>"]) if depth > 3 or r.random() < 0.5 else f"<{tag}>{_html(r, depth + 1)}</{tag}>")
    return "".join(out)


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    texts = {f"u{k}": _html(r) for k in range(60)} | {"empty": "", "none": None, "plain": "é é", "open": "<b><i>é"}
    sources = spark.createDataFrame(list(texts.items()), "uri string, text string")
    return texts, sources, twig.node_table(sources, "html")


def _key(uri, start, end, text, captures):
    return uri, start, end, text, tuple((c["name"], c["kind"], c["text"], c["start_byte"], c["end_byte"]) for c in captures)


@pytest.mark.parametrize("query", QUERIES)
def test_joins_find_what_walks_find(made, query):
    texts, sources, nodes = made
    compiled, want = tree_query.compile_query(query), set()
    for uri, text in texts.items():
        for row in lowering._query_rows(compiled, uri, trees.parse(text or "", "html")):
            want.add(_key(*row))
    rows = twig.find(nodes, sources, query).collect()
    got = [_key(x.uri, x.start_byte, x.end_byte, x.text, x.captures) for x in rows]
    assert len(got) == len(set(got)) and set(got) == want
    assert want or "unknown" in query or "not-match" in query


def test_plans_hold_no_python(made):
    _, sources, nodes = made
    plan = twig.find(nodes, sources, QUERIES[3])._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    plan = twig.ancestors(nodes, nodes.filter("kind = 'element'"))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_containment(made):
    _, _, nodes = made
    rows = nodes.collect()
    tag = {(x.uri, x.node_id): x.kind for x in rows}
    parent = {(x.uri, x.node_id): x.parent_id for x in rows}

    def above(uri, k):
        out = []
        while (k := parent[uri, k]) is not None:
            out.append(k)
        return out[::-1]

    outer = nodes.filter("kind = 'element'")
    asked = nodes.filter("kind in ('text', 'element')")
    keys = [(x.uri, x.node_id) for x in asked.collect()]
    paths = {k: [a for a in above(*k) if tag[k[0], a] == "element"] for k in keys}
    got = sorted((x.uri, x.node_id, x.ancestor_id, x.depth) for x in twig.ancestors(asked, outer).collect())
    assert got == sorted((u, k, a, d) for (u, k), p in paths.items() for d, a in enumerate(p, 1))
    nearest = {(x.uri, x.node_id): x.ancestor_id for x in twig.ancestors(asked, outer, nearest=True).collect()}
    assert nearest == {k: p[-1] for k, p in paths.items() if p}
    for negate in (False, True):
        below = {(x.uri, x.node_id) for x in twig.inside(asked, outer, negate).collect()}
        assert below == {k for k, p in paths.items() if bool(p) != negate}
        over = {(x.uri, x.node_id) for x in twig.having(outer, asked, negate).collect()}
        holders = {(u, a) for (u, _), p in paths.items() for a in p}
        assert over == {(x.uri, x.node_id) for x in outer.collect() if ((x.uri, x.node_id) in holders) != negate}
    none = nodes.filter("false")
    assert twig.ancestors(none, outer).count() == twig.ancestors(asked, none).count() == twig.inside(asked, none).count() == 0
