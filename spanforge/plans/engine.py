"""The engine facade: rule files and one-line expressions to query plans, plans to matches."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diagnostics as dx
from . import formula as fm
from .diagnostics import fail
from .dsl import parse_expression
from .rules import LANGUAGES, Rule, formula_of, parse_rules


@dataclass(frozen=True)
class EngineConfig:
    max_matches_per_rule: int | None = 10_000  # None: all, without a sort of a rule's matches
    max_capture_text_bytes: int = 1_048_576
    max_deep_search_nodes: int = 100_000
    enable_hcl: bool = False


def check_regexes(formula: fm.Decorated) -> None:
    """Regexes are compiled before anything runs."""
    for d in formula.walk():
        found = [d.node.pattern] if isinstance(d.node, fm.Regex) else []
        for rx in found + [c.regex for c in d.where if isinstance(c, fm.MetavariableRegex)]:
            try:
                re.compile(rx)
            except re.error as e:
                raise fail(dx.SCHEMA_INVALID, f"bad regex: {e}", d.span) from None


@dataclass(frozen=True)
class QueryPlan:
    rule_id: str
    language: str
    formula: fm.Decorated
    message: str | None = None
    severity: str | None = None

    def execute(self, sources: DataFrame, config: EngineConfig | None = None) -> DataFrame:
        return Engine(config).execute([self], sources)


class Engine:
    def __init__(self, config: EngineConfig | None = None):
        self.config = config or EngineConfig()

    def compile_yaml(self, text: str, uri: str | None = None) -> list[QueryPlan]:
        """One plan for each rule and language; the first problem of the file is raised."""
        return self.compile_rules(parse_rules(text, uri))

    def compile_rules(self, rules: list[Rule]) -> list[QueryPlan]:
        for rule in rules:
            if rule.mode != "search":
                raise fail(dx.UNSUPPORTED_MODE, f"rule mode `{rule.mode}` can't be executed", rule.mode_span or rule.span, "only `search` rules run")
        return [p for rule in rules for p in self._plans(rule)]

    def _plans(self, rule: Rule) -> list[QueryPlan]:
        formula = formula_of(rule)
        fm.validate(formula)
        check_regexes(formula)
        for language in rule.languages:
            if language not in LANGUAGES and language not in ("html", "prose", "generic", "regex"):
                raise fail(dx.SCHEMA_INVALID, f"unsupported language `{language}`", rule.span)
        return [QueryPlan(rule.id, language, formula, rule.message, rule.severity) for language in rule.languages]

    def compile_dsl(self, rule_id: str, language: str, text: str) -> QueryPlan:
        formula = parse_expression(text)
        fm.validate(formula)
        check_regexes(formula)
        return QueryPlan(rule_id, language, formula)

    def executable(self, plans: list[QueryPlan]) -> None:
        """Raises if this engine's configuration doesn't run one of the plans."""
        if any(p.language == "hcl" for p in plans) and not self.config.enable_hcl:
            raise fail(dx.UNSUPPORTED_MODE, "hcl is not enabled")

    def execute(self, plans: list[QueryPlan] | QueryPlan, sources: DataFrame) -> DataFrame:
        """sources (uri, text, and lang if plans of several languages meet) to matches.

        rule_id, language, uri, start_byte, end_byte, text, captures, message, severity, fix.
        """
        from ..operators import lowering

        plans = [plans] if isinstance(plans, QueryPlan) else list(plans)
        if not plans:
            raise ValueError("no plans to execute")
        out, deep = None, self.config.max_deep_search_nodes
        self.executable(plans)
        # all atoms of all plans of a language are looked for in one pass over its files
        read = {}
        for language in dict.fromkeys(p.language for p in plans):
            own = sources.filter(F.col("lang") == language) if "lang" in sources.columns else sources
            read[language] = lowering.scanned([p.formula for p in plans if p.language == language], own, language, deep)
        for p in plans:
            own = read[p.language]
            found = lowering.lower(p.formula, own, p.language, deep).select(*lowering.MATCH_COLUMNS)
            found = found.select(F.lit(p.rule_id).alias("rule_id"), F.lit(p.language).alias("language"), *lowering.MATCH_COLUMNS, F.lit(p.message).cast("string").alias("message"), F.lit(p.severity).cast("string").alias("severity"), F.lit(p.formula.fix).cast("string").alias("fix"))
            out = found if out is None else out.unionByName(found)
        if self.config.max_matches_per_rule is not None:
            out = lowering.cap(out, self.config.max_matches_per_rule)
        return lowering.cap_capture_text(out, self.config.max_capture_text_bytes)
