"""Checks of many rule files at once: a row a file, with what it compiles to or what is wrong with it, and where.

Files are rows (uri, text), one rule file each; they are compiled apart from one another, in the tasks,
which a table of few files is dealt to anew. A null text is an empty file.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.files import spread
from . import formula as fm
from .diagnostics import Diagnostic, RuleError
from .engine import Engine, EngineConfig
from .rules import parse_rules

_KINDS = {"uri": pa.string(), "n_rules": pa.int32(), "n_plans": pa.int32(), "languages": pa.string(), "kind": pa.string(), "atoms": pa.list_(pa.string()), "constraints": pa.list_(pa.string()), "fix": pa.string(), "bound_as": pa.string(), "min_version": pa.string(), "max_version": pa.string(), "code": pa.string(), "message": pa.string(), "start_byte": pa.int64(), "end_byte": pa.int64(), "notes": pa.list_(pa.string())}
SCHEMA = "uri string, n_rules int, n_plans int, languages string, kind string, atoms array<string>, constraints array<string>, fix string, bound_as string, min_version string, max_version string, code string, message string, start_byte long, end_byte long, notes array<string>"


def atoms_of(formula: fm.Decorated) -> list[str]:
    """Texts of a formula's atoms, in order."""
    texts = {fm.Pattern: "text", fm.Regex: "pattern", fm.TreeQuery: "query"}
    return [getattr(d.node, texts[type(d.node)]) for d in formula.walk() if type(d.node) in texts]


def constraints_of(formula: fm.Decorated) -> list[str]:
    def said(c: fm.Constraint) -> str:
        if isinstance(c, fm.MetavariableRegex):
            return f"{c.metavariable} =~ {c.regex}"
        return f"{c.metavariable} is {c.pattern}" if isinstance(c, fm.MetavariablePattern) else c.payload

    return [said(c) for d in formula.walk() for c in d.where]


def check_file(text: str, uri: str | None, config: EngineConfig | None = None) -> dict:
    """What a rule file comes to: plans, and the first of them; or the first problem."""
    row: dict = dict.fromkeys(_KINDS) | {"uri": uri, "n_plans": 0, "n_rules": 0}
    engine = Engine(config)
    try:
        rules = parse_rules(text, uri)
        plans = engine.compile_rules(rules)
        engine.executable(plans)
    except RuleError as e:
        # as a reader of the report would take it up
        found = Diagnostic.from_dict(json.loads(e.to_json())[0])
        span = found.primary_span
        return row | {"code": found.code, "message": found.message, "start_byte": span and span.start, "end_byte": span and span.end, "notes": list(found.notes)}
    row |= {"n_rules": len(rules), "n_plans": len(plans), "languages": ",".join(p.language for p in plans)}
    if plans:
        first = plans[0].formula
        row |= {"kind": type(first.node).__name__, "atoms": atoms_of(first), "constraints": constraints_of(first), "fix": first.fix, "bound_as": first.as_name}
    if rules:
        row |= {"min_version": rules[0].min_version, "max_version": rules[0].max_version}
    return row


def check_rule_files(files: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """files (uri, text) to one row each: the plans of the file, or code, message and byte span of its first problem."""

    def run(batches):
        for batch in batches:
            rows = [check_file(text or "", uri, config) for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in _KINDS.items()], names=list(_KINDS))

    return spread(files.select("uri", "text")).mapInArrow(run, SCHEMA)
