"""Structural patterns with metavariables over syntax trees.

Two dialects. The first has `$X` (one node), `$$$X` (any run of siblings, shortest first) and `$_`;
children, anonymous tokens included, match one to one. The second adds `...` (any run),
`$...X` (a captured run) and `<... x ...>` (x anywhere below), and ignores comments. Runs
are matched with a memo table, so no pattern takes exponential time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import diagnostics as dx
from ..plans.diagnostics import fail
from ..sources.files import spread
from ..sources.trees import Node, Tree, parse, position

_MARK = "__SPAN_METAVAR_"
_PLACEHOLDER = re.compile(rf"^{_MARK}([A-Z_0-9]*)__$")
_NAME = re.compile(r"[A-Z_][A-Z0-9_]*")
_COMMENTS = ("comment", "line_comment", "block_comment")
#: Kinds that a lone placeholder inside doesn't turn into that placeholder.
_KEPT = ("ERROR", "block", "statement_block", "document", "module", "program", "source_file")
MAX_DEEP_NODES = 100_000


@dataclass(frozen=True)
class Metavariable:
    name: str  # "_" is a wildcard
    many: bool = False


def lex(source: str) -> Iterator[tuple[str, str]]:
    """("text", literal), ("one", name), ("many", name), ("run", ""), ("deep", fragment)."""
    at, text = 0, []
    while at < len(source):
        if source.startswith("<...", at):
            end = source.find("...>", at + 4)
            if end < 0:
                raise fail(dx.SNIPPET_PARSE_FAILED, "unclosed <... ...>")
            yield "text", "".join(text)
            yield "deep", source[at + 4 : end].strip()
            at, text = end + 4, []
        elif source.startswith("$...", at) and (m := _NAME.match(source, at + 4)):
            yield "text", "".join(text)
            yield "many", m[0]
            at, text = m.end(), []
        elif source.startswith("...", at):
            yield "text", "".join(text)
            yield "run", ""
            at, text = at + 3, []
        elif source[at] == "$":
            n = len(source) - at - len(source[at:].lstrip("$"))
            m = _NAME.match(source, at + n)
            if n not in (1, 3) or not m:
                raise fail(dx.SNIPPET_PARSE_FAILED, f"bad metavariable at {at}: use $NAME or $$$NAME")
            yield "text", "".join(text)
            yield ("one" if n == 1 else "many"), m[0]
            at, text = m.end(), []
        else:
            text.append(source[at])
            at += 1
    yield "text", "".join(text)


@dataclass
class Compiled:
    source: str
    language: str
    root: Node
    tree: Tree
    #: Placeholder key to metavariable; the kind of a name is that of its first occurrence.
    variables: dict[str, Metavariable]
    deep: dict[str, Compiled]
    extended: bool
    #: What each of the pattern's own nodes stands for, once asked.
    stands: dict[int, tuple | None] = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def needs(self) -> list[str]:
        return literals(self)

    def names(self) -> list[str]:
        return [v.name for v in self.variables.values() if v.name not in ("_", "")] + [n for d in self.deep.values() for n in d.names()]


_WRAPPERS = {
    "python": lambda s: "def __span_wrapper__():\n" + "".join(f"    {x}\n" for x in s.splitlines() or ["pass"]),
    "rust": lambda s: f"fn __span_wrapper__() {{ {s.rstrip() + ('' if s.rstrip().endswith((';', '}')) else ';')} }}",
    "typescript": lambda s: f"function __span_wrapper__() {{ {s} }}",
}


def compile_pattern(source: str, language: str, expression: bool = False) -> Compiled:
    """expression: the second dialect throughout, in which a lone expression matches wherever it stands and not only as a statement."""
    variables: dict[str, Metavariable] = {}
    deep: dict[str, Compiled] = {}
    out: list[str] = []
    extended = False
    for kind, value in lex(source):
        if kind == "text":
            out.append(value)
        elif kind in ("one", "many"):
            variables.setdefault(value, Metavariable(value, kind == "many"))
            out.append(f"{_MARK}{value}__")
        else:
            extended = True
            key = f"0{len(variables)}"
            if kind == "run":
                variables[key] = Metavariable("", True)
            else:
                variables[key] = Metavariable("", False)
                deep[key] = compile_pattern(value, language, True)
            out.append(f"{_MARK}{key}__")
    text = "".join(out)
    extended = extended or expression or "$..." in source
    tree, wrapped = parse(text, language), False
    if tree.has_errors() and language in _WRAPPERS:
        tree, wrapped = parse(_WRAPPERS[language](text), language), True
    if tree.has_errors():
        raise fail(dx.SNIPPET_PARSE_FAILED, f"pattern is not valid {language}")
    body = tree.root
    if wrapped:
        body = next(n for n in tree.root.walk() if n.kind in ("block",))
    inner = body.named_children()
    if len(inner) != 1:
        raise fail(dx.SNIPPET_PARSE_FAILED, "a pattern holds exactly one node")
    root = inner[0]
    while language == "prose" and len(root.children) == 1:
        root = root.children[0]
    if root.kind == "expression_statement" and (extended or language != "python") and len(root.named_children()) == 1:
        root = root.named_children()[0]
    return Compiled(source, language, root, tree, variables, deep, extended)


@dataclass(frozen=True)
class Capture:
    """One node, or a run of nodes."""

    kind: str
    text: str
    start: int
    end: int
    many: tuple[tuple[str, str], ...] | None = None

    def agrees(self, other: Capture) -> bool:
        return (self.many is None) == (other.many is None) and (self.kind, self.text, self.many) == (other.kind, other.text, other.many)


@dataclass(frozen=True)
class Match:
    kind: str
    start: int
    end: int
    captures: dict[str, Capture]


class _Matcher:
    def __init__(self, pattern: Compiled, tree: Tree, deep: int = MAX_DEEP_NODES):
        self.p, self.t = pattern, tree
        self.budget = deep

    def variable(self, node: Node) -> tuple[str, Metavariable] | None:
        """The metavariable a pattern node stands for, also when it is the node's only named child."""
        known = self.p.stands
        if id(node) not in known:
            known[id(node)] = self._variable(node)
        return known[id(node)]

    def _variable(self, node: Node) -> tuple[str, Metavariable] | None:
        while True:
            m = _PLACEHOLDER.match(self.p.tree.text(node)) if not node.children else None
            if m:
                return (m[1], self.p.variables[m[1]]) if m[1] in self.p.variables else None
            named = node.named_children()
            if self.p.extended and node.kind != "expression_statement" or len(named) != 1 or node.kind in _KEPT or not node.children:
                return None
            node = named[0]

    def kids(self, node: Node) -> list[Node]:
        return [c for c in node.children if c.kind not in _COMMENTS] if self.p.extended else node.children

    def bind(self, name: str, value: Capture, found: dict) -> dict | None:
        if name in ("_", ""):
            return found
        old = found.get(name)
        if old is None:
            return {**found, name: value}
        return found if old.agrees(value) else None

    def one(self, node: Node) -> Capture:
        return Capture(node.kind, self.t.text(node), node.start, node.end)

    def run(self, nodes: list[Node], empty_at: int) -> Capture:
        s, e = (nodes[0].start, nodes[-1].end) if nodes else (empty_at, empty_at)
        return Capture("", self.t.source[s:e].decode(errors="replace"), s, e, tuple((n.kind, self.t.text(n)) for n in nodes))

    def match(self, p: Node, t: Node, found: dict) -> dict | None:
        if v := self.variable(p):
            key, var = v
            if key in self.p.deep:
                return self.below(self.p.deep[key], t, found)
            return self.bind(var.name, self.one(t), found)
        if p.kind != t.kind:
            return None
        if not p.children or not t.children:
            return found if not p.children and not t.children and self.p.tree.text(p) == self.t.text(t) else None
        return self.sequence(self.kids(p), self.kids(t), t, found)

    def below(self, inner: Compiled, t: Node, found: dict) -> dict | None:
        sub = _Matcher(inner, self.t, self.budget)  # one budget, however deep patterns nest
        for n in t.walk():
            sub.budget -= 1
            if sub.budget < 0:
                break
            if (r := sub.match(inner.root, n, found)) is not None:
                self.budget = sub.budget
                return r
        self.budget = sub.budget
        return None

    def sequence(self, ps: list[Node], ts: list[Node], parent: Node, found: dict) -> dict | None:
        """Shortest runs first. Failures are remembered by place and bindings."""
        many = [bool((v := self.variable(p)) and v[1].many and v[0] not in self.p.deep) for p in ps]
        if not any(many):
            # one to one: nothing to go back to
            if len(ps) != len(ts):
                return None
            for p, t in zip(ps, ts):
                if (found := self.match(p, t, found)) is None:
                    return None
            return found
        dead: set = set()

        def go(i: int, j: int, b: dict) -> dict | None:
            if i == len(ps):
                return b if j == len(ts) else None
            key = (i, j, tuple(sorted((k, v.text) for k, v in b.items())))
            if key in dead:
                return None
            if many[i]:
                name = self.variable(ps[i])[1].name
                at = ts[j].start if j < len(ts) else ts[-1].end if ts else parent.start
                for k in range(j, len(ts) + 1):
                    nb = self.bind(name, self.run(ts[j:k], at), b)
                    if nb is not None and (r := go(i + 1, k, nb)) is not None:
                        return r
            elif j < len(ts):
                nb = self.match(ps[i], ts[j], b)
                if nb is not None and (r := go(i + 1, j + 1, nb)) is not None:
                    return r
            dead.add(key)
            return None

        return go(0, 0, found)


def literals(pattern: Compiled) -> list[str]:
    """Words that a text must hold for the pattern to match in it: leaves are compared as they are, so any that isn't under a metavariable is one."""
    found, own = set(), _Matcher(pattern, pattern.tree)

    def go(node: Node) -> None:
        if v := own.variable(node):
            if v[0] in pattern.deep:
                found.update(literals(pattern.deep[v[0]]))
        elif node.children:
            for c in own.kids(node):
                go(c)
        elif node.kind not in _COMMENTS and re.fullmatch(r"[^\W\d]\w+", text := pattern.tree.text(node)):
            found.add(text)

    go(pattern.root)
    return sorted(found)


def holding(sources: DataFrame, needs: list[list[str]]) -> DataFrame:
    """The sources that hold all words of one of the lists at least: the others needn't be parsed. An empty list is held by all."""
    if not all(needs):
        return sources
    cond = F.lit(False)
    for words in needs:
        one = F.lit(True)
        for w in words:
            one = one & F.contains("text", F.lit(w))
        cond = cond | one
    return sources.filter(cond)


def find_all(pattern: Compiled, tree: Tree, deep: int = MAX_DEEP_NODES) -> list[Match]:
    """Every match in pre-order, nested ones too."""
    var = _Matcher(pattern, tree).variable(pattern.root)
    out = []
    for n in tree.root.walk():
        if var is None and n.kind != pattern.root.kind:
            continue
        m = _Matcher(pattern, tree, deep)
        if (found := m.match(pattern.root, n, {})) is not None:
            out.append(Match(n.kind, n.start, n.end, found))
    return out


def find_first(pattern: Compiled, tree: Tree, deep: int = MAX_DEEP_NODES) -> Match | None:
    for n in tree.root.walk():
        if (found := _Matcher(pattern, tree, deep).match(pattern.root, n, {})) is not None:
            return Match(n.kind, n.start, n.end, found)
    return None


CAPTURE = pa.struct([("name", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
MATCH_SCHEMA = "uri string, kind string, text string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, captures array<struct<name:string,kind:string,text:string,start_byte:long,end_byte:long>>"
_MATCH_KINDS = [pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(CAPTURE)]


def match_sources(sources: DataFrame, pattern: str, language: str, first_only: bool = False, expression: bool = False, deep: int = MAX_DEEP_NODES) -> DataFrame:
    """sources (uri, text) to matches, 1-based positions, captures sorted by name."""
    needs = [literals(compile_pattern(pattern, language, expression))]  # errors belong to the driver

    def run(batches):
        compiled = compile_pattern(pattern, language, expression)
        for batch in batches:
            rows = []
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist()):
                tree = parse(text or "", language)
                starts = tree.line_starts()
                found = [m for m in [find_first(compiled, tree, deep)] if m] if first_only else find_all(compiled, tree, deep)
                for m in found:
                    (r0, c0), (r1, c1) = position(starts, m.start), position(starts, m.end)
                    captures = [{"name": f"${k}", "kind": v.kind, "text": v.text, "start_byte": v.start, "end_byte": v.end} for k, v in sorted(m.captures.items())]
                    rows.append((uri, m.kind, tree.source[m.start : m.end].decode(errors="replace"), m.start, m.end, r0 + 1, c0 + 1, r1 + 1, c1 + 1, captures))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _MATCH_KINDS)], names=[x.split()[0] for x in MATCH_SCHEMA.split(", ", 9)])

    return spread(holding(sources.select("uri", "text"), needs)).mapInArrow(run, MATCH_SCHEMA)
