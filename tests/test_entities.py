"""Entities, comments, documentation and imports of single files."""

import pytest

from spanforge.operators import cards


def _one(text, language, name):
    return next(e for e in cards.extract(text, language) if e.name == name)


def test_python_callables():
    text = '@route("a  b")\ndef f(a, b=1, /, *args: int, c: str = "x", **kw) -> None:\n    r"""raw\\n doc"""\n    x = y = 1\n    self.z = 2\n    if a: pass\n    elif b: pass\n    for (p, *q) in c: pass\n    w: int = 3\n    return (v := 1)\n'
    e = _one(text, "python", "f")
    assert e.params == [("a", ""), ("b", ""), ("*args", "int"), ("c", "str"), ("kw", "")] and e.returns == "None"
    assert e.decorators == ['@route("a  b")'] and text[e.start :].startswith("def f") and e.anchor == 0
    assert e.docstring == "raw\\n doc" and [k for k, _ in e.locals] == ["x", "y", "w"] and [k for k, _ in e.branches] == ["if", "for"]
    assert e.signature == 'def f(a, b=1, /, *args: int, c: str = "x", **kw) -> None:'
    for bad in ('b"""x"""', 'f"""x"""'):
        assert _one(f"def f():\n    {bad}\n", "python", "f").docstring is None
    assert _one('def f():\n    "a" "b"\n', "python", "f").docstring == "ab"
    assert cards.extract("def f(", "python") == []


@pytest.mark.parametrize(
    ("language", "text", "row", "want"),
    [
        ("python", "# a\n#\n#  b\ndef f(): pass", 3, ["a", "", "b"]),
        ("python", "# a\n\n# b\ndef f(): pass", 3, ["b"]),
        ("rust", "/// a\n//! b\n/** c */\n* d\nfn f() {}", 4, ["a", "b", "c", "d"]),
        ("rust", "// a\n//\n// b\nfn f() {}", 3, ["b"]),
        ("rust", "// a\n#[inline]\nfn f() {}", 2, []),
        ("typescript", "/**\n * a\n */\nfunction f() {}", 3, []),
        ("typescript", "x\n// a\n/* b */\nfunction f() {}", 3, ["a", "b"]),
    ],
)
def test_comments(language, text, row, want):
    assert cards.leading_comments(text.split("\n"), row, language) == want


@pytest.mark.parametrize(
    ("language", "text", "names", "end"),
    [
        ("python", "from __future__ import annotations\nimport os\nfrom a import (\n    b,\n)\n\nimport late\n", ["os", "a import (\n    b,\n)"], "\n)"),
        ("python", "import a\nimport b\nx = (\n", ["a", "b"], "import b"),
        ("rust", "pub use a::b;\npub(crate) use c;\nextern crate d;\nfn f() {}\nuse late;\n", ["a::b", "c", "d"], "crate d;"),
        ("typescript", 'import { join } from "path";\nimport type { W } from "./w";\nf();\n', ['{ join } from "path"', 'type { W } from "./w"'], '"./w";'),
    ],
)
def test_imports(language, text, names, end):
    start, stop, got = cards.import_block(text, language)
    assert got == names and text[:stop].endswith(end)
    assert cards.import_block("x = 1\n", language) is None


def test_detail_levels(spark):
    text = "import os\n\n# says so\n@dec(1)\ndef f(a):\n    return a\n\nclass A:\n    pass\n"
    found = cards.entities(spark.createDataFrame([("/d/a.b.py", "python", text)], "uri string, lang string, text string"))
    by_level = {level: {r.symbol.name: r for r in cards.cards(found, level).collect()} for level in ("minimal", "signature", "structure", "semantic", "full")}
    shown = {level: [c for c in ("signature", "doc", "attachments", "structure", "metrics", "interstitial") if rows["f"][c] is not None] for level, rows in by_level.items()}
    full = ["signature", "doc", "attachments", "structure", "metrics"]
    assert shown == {"minimal": [], "signature": ["signature"], "structure": full, "semantic": full, "full": full}
    assert [by_level[level]["A"].provenance for level in ("structure", "semantic", "full")] == [["tree_sitter"], ["tree_sitter", "tree_sitter_degraded_semantic"], ["tree_sitter", "tree_sitter_degraded_semantic", "tree_sitter_degraded_full"]]
    f, a, module = (by_level["structure"][n] for n in ("f", "A", "a.b"))
    assert (f.doc.docstring, f.doc.summary, f.attachments.normalized.decorators, f.attachments.doc_comments) == ("says so", "says so", ["dec"], ["says so"])
    assert a.signature is None and a.doc is None and a.attachments is None and a.metrics.cyclomatic == 1
    assert module.interstitial.normalized == ["os"] and (module.symbol.range.start.line, module.symbol.range.end.line, module.metrics.lines) == (0, 8, 9)
