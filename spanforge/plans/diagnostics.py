"""Diagnostics: stable codes, and the exception that carries them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# The stable diagnostic codes.
YAML_PARSE = "E_YAML_PARSE"
DSL_PARSE = "E_DSL_PARSE"
SCHEMA_INVALID = "E_SCHEMA_INVALID"
UNSUPPORTED_MODE = "E_UNSUPPORTED_MODE"
INVALID_NOT_IN_OR = "E_INVALID_NOT_IN_OR"
MISSING_POSITIVE_TERM = "E_MISSING_POSITIVE_TERM_IN_AND"
SNIPPET_PARSE_FAILED = "E_PATTERN_SNIPPET_PARSE_FAILED"
UNSUPPORTED_CONSTRAINT = "E_UNSUPPORTED_CONSTRAINT"
TREE_QUERY_INVALID = "E_TREE_QUERY_INVALID"
NOT_IMPLEMENTED = "NOT_IMPLEMENTED"
CODES = (YAML_PARSE, DSL_PARSE, SCHEMA_INVALID, UNSUPPORTED_MODE, INVALID_NOT_IN_OR, MISSING_POSITIVE_TERM, SNIPPET_PARSE_FAILED, UNSUPPORTED_CONSTRAINT, TREE_QUERY_INVALID, NOT_IMPLEMENTED)


@dataclass(frozen=True)
class SourceSpan:
    """Half-open byte range of a rule file."""

    start: int
    end: int
    uri: str | None = None


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    primary_span: SourceSpan | None = None
    notes: tuple[str, ...] = field(default=())

    def to_dict(self) -> dict:
        span = self.primary_span
        return {"code": self.code, "message": self.message, "primary_span": span and {k: v for k, v in vars(span).items() if v is not None}, "notes": list(self.notes)}

    @classmethod
    def from_dict(cls, d: dict) -> Diagnostic:
        span = d.get("primary_span", d.get("span"))
        return cls(d["code"], d["message"], span and SourceSpan(span["start"], span["end"], span.get("uri")), tuple(d.get("notes") or ()))


class RuleError(Exception):
    """A report of one or more diagnostics."""

    def __init__(self, *diagnostics: Diagnostic):
        self.diagnostics = diagnostics
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))

    @property
    def code(self) -> str:
        return self.diagnostics[0].code

    def to_json(self) -> str:
        return json.dumps([d.to_dict() for d in self.diagnostics])


def fail(code: str, message: str, span: SourceSpan | None = None, *notes: str) -> RuleError:
    return RuleError(Diagnostic(code, message, span, notes))
