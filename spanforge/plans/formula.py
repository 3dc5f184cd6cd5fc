"""The formula algebra both rule syntaxes normalise to, and its checks.

Trees are Python objects on the driver, never columns: Spark types don't recurse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from . import diagnostics as dx
from .diagnostics import SourceSpan, fail

MAX_DEPTH = 1000


@dataclass(frozen=True)
class Pattern:
    text: str


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass(frozen=True)
class TreeQuery:
    query: str


Atom = Pattern | Regex | TreeQuery


@dataclass(frozen=True)
class Not:
    inner: Decorated


@dataclass(frozen=True)
class Inside:
    inner: Decorated


@dataclass(frozen=True)
class Anywhere:
    inner: Decorated


@dataclass(frozen=True)
class And:
    branches: tuple[Decorated, ...]


@dataclass(frozen=True)
class Or:
    branches: tuple[Decorated, ...]


Formula = Pattern | Regex | TreeQuery | Not | Inside | Anywhere | And | Or


@dataclass(frozen=True)
class MetavariableRegex:
    metavariable: str
    regex: str


@dataclass(frozen=True)
class MetavariablePattern:
    metavariable: str
    pattern: str


@dataclass(frozen=True)
class OtherConstraint:
    """Kept as JSON; whether it can run is decided when the plan is executed."""

    payload: str


Constraint = MetavariableRegex | MetavariablePattern | OtherConstraint


@dataclass(frozen=True)
class Decorated:
    node: Formula
    where: tuple[Constraint, ...] = field(default=())
    as_name: str | None = None
    fix: str | None = None
    span: SourceSpan | None = None

    def children(self) -> tuple[Decorated, ...]:
        if isinstance(self.node, (And, Or)):
            return self.node.branches
        return (self.node.inner,) if isinstance(self.node, (Not, Inside, Anywhere)) else ()

    def walk(self) -> Iterator[Decorated]:
        todo = [self]
        while todo:
            d = todo.pop()
            yield d
            todo.extend(reversed(d.children()))

    def decorated(self, **changes) -> Decorated:
        return replace(self, **changes)


def bare(node: Formula, span: SourceSpan | None = None) -> Decorated:
    return Decorated(node, span=span)


def conj(*branches: Decorated | Formula) -> Decorated:
    return bare(And(tuple(b if isinstance(b, Decorated) else bare(b) for b in branches)))


def disj(*branches: Decorated | Formula) -> Decorated:
    return bare(Or(tuple(b if isinstance(b, Decorated) else bare(b) for b in branches)))


def is_positive(d: Decorated) -> bool:
    """Whether a formula can produce matches of its own."""
    if isinstance(d.node, (And, Or)):
        return any(is_positive(b) for b in d.node.branches)
    return isinstance(d.node, (Pattern, Regex, TreeQuery))


def validate(formula: Decorated) -> None:
    """Depth first, then negation under a disjunction, then conjunctions without a positive term.

    One bottom-up pass with an explicit stack, so the depth limit and not Python's stack decides.
    """
    order: list[tuple[Decorated, SourceSpan | None, int]] = []
    todo: list[tuple[Decorated, SourceSpan | None, int]] = [(formula, formula.span, 1)]
    while todo:
        d, near, depth = todo.pop()
        near = d.span or near
        if depth > MAX_DEPTH:
            raise fail(dx.SCHEMA_INVALID, f"formula nesting depth exceeds limit of {MAX_DEPTH}: {depth}", near)
        order.append((d, near, depth))
        todo.extend((c, near, depth + 1) for c in reversed(d.children()))
    positive: dict[int, bool] = {}
    negated: dict[int, tuple] = {}  # id to (span of the first negation,)
    in_or: list[tuple[int, SourceSpan | None]] = []
    lacking: list[tuple[int, SourceSpan | None]] = []
    for at in range(len(order) - 1, -1, -1):
        d, near, _ = order[at]
        kids = d.children()
        first = next((negated[id(c)] for c in kids if id(c) in negated), None)
        if isinstance(d.node, Not):
            first = (d.span or (first[0] if first else None),)
        if first:
            negated[id(d)] = first
        if isinstance(d.node, Or):
            if bad := next((c for c in kids if id(c) in negated), None):
                in_or.append((at, negated[id(bad)][0] or bad.span or near))
        if isinstance(d.node, (And, Or)):
            positive[id(d)] = any(positive[id(c)] for c in kids)
        else:
            positive[id(d)] = isinstance(d.node, (Pattern, Regex, TreeQuery))
        if isinstance(d.node, And) and not positive[id(d)]:
            lacking.append((at, d.span or next((c.span for c in kids if c.span), None) or near))
    if in_or:
        raise fail(dx.INVALID_NOT_IN_OR, "negated terms are not allowed inside a disjunction", min(in_or, key=lambda x: x[0])[1])
    if lacking:
        raise fail(dx.MISSING_POSITIVE_TERM, "a conjunction must hold at least one positive term", min(lacking, key=lambda x: x[0])[1])
