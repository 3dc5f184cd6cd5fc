"""Tree queries: parenthesised node patterns with captures and predicates.

    (call (identifier) @name (#match? @name "^get")) @call

A named child pattern matches some child, in order; `_` is any node; `.` is not supported.
Captures are reported as $name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..plans import diagnostics as dx
from ..plans.diagnostics import fail
from ..sources.trees import Node, Tree

_TOKEN = re.compile(r'\s+|;[^\n]*|(\(|\)|"(?:\\.|[^"\\])*"|@[\w.-]+|#[\w-]+\??!?|[\w-]+:|[A-Za-z_][\w-]*)')


@dataclass
class QueryNode:
    kind: str
    children: list[QueryNode] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    literal: str | None = None


@dataclass
class Query:
    root: QueryNode
    predicates: list[tuple[str, list[str]]]
    names: list[str]


def compile_query(text: str) -> Query:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise fail(dx.TREE_QUERY_INVALID, f"unexpected {text[at]!r} in tree query at {at}")
        if m[1]:
            tokens.append(m[1])
        at = m.end()
    predicates: list[tuple[str, list[str]]] = []
    names: list[str] = []
    k = 0

    def node() -> QueryNode | None:
        nonlocal k
        if k >= len(tokens):
            raise fail(dx.TREE_QUERY_INVALID, "unbalanced tree query")
        t = tokens[k]
        k += 1
        if t.endswith(":"):
            return node()  # providers have no field names
        if t.startswith('"'):
            out = QueryNode("", literal=t[1:-1])
        elif t == "_":
            out = QueryNode("_")
        elif t == "(":
            if k < len(tokens) and tokens[k].startswith("#"):
                name, args = tokens[k], []
                k += 1
                while k < len(tokens) and tokens[k] != ")":
                    args.append(tokens[k].strip('"'))
                    k += 1
                if name not in ("#eq?", "#not-eq?", "#match?", "#not-match?") or k >= len(tokens) or len(args) != 2:
                    raise fail(dx.TREE_QUERY_INVALID, f"predicate not understood: {name}")
                k += 1
                predicates.append((name, args))
                return None
            if k >= len(tokens) or not re.match(r"[A-Za-z_]", tokens[k]):
                raise fail(dx.TREE_QUERY_INVALID, "a node pattern needs a kind")
            out = QueryNode(tokens[k])
            k += 1
            while k < len(tokens) and tokens[k] != ")":
                if (child := node()) is not None:
                    out.children.append(child)
            if k >= len(tokens):
                raise fail(dx.TREE_QUERY_INVALID, "unbalanced tree query")
            k += 1
        else:
            raise fail(dx.TREE_QUERY_INVALID, f"unexpected {t!r} in tree query")
        while k < len(tokens) and tokens[k].startswith("@"):
            out.names.append(tokens[k][1:])
            names.append(tokens[k][1:])
            k += 1
        return out

    root = node()
    while k < len(tokens):
        if node() is not None:
            raise fail(dx.TREE_QUERY_INVALID, "a tree query holds one pattern")
    if root is None:
        raise fail(dx.TREE_QUERY_INVALID, "a tree query holds one pattern")
    return Query(root, predicates, names)


def _match(q: QueryNode, n: Node, tree: Tree) -> Iterator[list[tuple[str, Node]]]:
    if q.literal is not None:
        if n.children or tree.text(n) != q.literal:
            return
    elif q.kind != "_" and q.kind != n.kind or not n.named:
        return
    own = [(name, n) for name in q.names]

    def go(i: int, j: int) -> Iterator[list[tuple[str, Node]]]:
        if i == len(q.children):
            yield []
            return
        for k in range(j, len(n.children)):
            for found in _match(q.children[i], n.children[k], tree):
                for rest in go(i + 1, k + 1):
                    yield found + rest

    for found in go(0, 0):
        yield own + found


def _holds(query: Query, found: list[tuple[str, Node]], tree: Tree) -> bool:
    texts = {name: tree.text(n) for name, n in found}
    for name, (a, b) in query.predicates:
        left = texts.get(a[1:], "") if a.startswith("@") else a
        right = texts.get(b[1:], "") if b.startswith("@") else b
        ok = left == right if "eq" in name else re.search(right, left) is not None
        if ok == ("not" in name):
            return False
    return True


def find(query: Query, tree: Tree) -> Iterator[tuple[Node, list[tuple[str, Node]]]]:
    for n in tree.root.walk():
        for found in _match(query.root, n, tree):
            if _holds(query, found, tree):
                yield n, found
