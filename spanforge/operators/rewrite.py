"""Template rewriting of structural matches, a file at a time on the executors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans import diagnostics as dx
from ..plans.diagnostics import fail
from ..sources.files import spread
from ..sources.trees import parse
from . import matcher

_REF = re.compile(r"(\$+)([A-Z_][A-Z0-9_]*)?")


@dataclass(frozen=True)
class RewriteRule:
    pattern: str
    replacement: str
    language: str

    def check(self) -> matcher.Compiled:
        """Every variable of the replacement must be bound by the pattern."""
        compiled = matcher.compile_pattern(self.pattern, self.language)
        known = set(compiled.names()) | {"_"}
        for dollars, name in _REF.findall(self.replacement):
            if name and len(dollars) in (1, 3) and name not in known:
                raise fail(dx.SCHEMA_INVALID, f"replacement uses unbound metavariable ${name}")
        return compiled


def substitute(template: str, captures: dict[str, str]) -> str:
    """$X and $$$X to captures; $$ stays, $_ is empty, an unknown $X stays and an unknown $$$X goes."""

    def one(m: re.Match) -> str:
        dollars, name = len(m[1]), m[2] or ""
        if not name or dollars == 2:
            return m[0]
        if name == "_":
            return ""
        if dollars not in (1, 3):
            return m[0]
        if name in captures:
            return captures[name]
        return m[0] if dollars == 1 else ""

    return _REF.sub(one, template)


def rewrite_text(text: str, compiled: matcher.Compiled, replacement: str) -> tuple[str, int]:
    """The new text and the number of matches; of nested matches only the outermost is replaced."""
    if not all(w in text for w in compiled.needs):
        return text, 0
    tree = parse(text, compiled.language)
    found = matcher.find_all(compiled, tree)
    raw, out, at = tree.source, [], 0
    for m in sorted(found, key=lambda m: (m.start, -m.end)):
        if m.start < at:
            continue
        out += [raw[at : m.start], substitute(replacement, {k: v.text for k, v in m.captures.items()}).encode()]
        at = m.end
    return b"".join([*out, raw[at:]]).decode(errors="replace"), len(found)


def apply_all(sources: DataFrame, rules: list[RewriteRule]) -> DataFrame:
    """sources (uri, text) to uri, text, replacements, changed; rules apply one after another to the evolving text."""
    for r in rules:
        r.check()

    def run(batches):
        compiled = [(r.check(), r.replacement) for r in rules]
        for batch in batches:
            texts, counts, changed = [], [], []
            for old in batch.column("text").to_pylist():
                text, total = old or "", 0
                for c, replacement in compiled:
                    text, n = rewrite_text(text, c, replacement)
                    total += n
                texts.append(text)
                counts.append(total)
                changed.append(text != (old or ""))
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(changed, pa.bool_())], names=["uri", "text", "replacements", "changed"])

    return spread(sources.select("uri", "text")).mapInArrow(run, "uri string, text string, replacements long, changed boolean")
