"""Symbol cards: entities of source files with signature, structure, attachments and stable ids.

Entities are found on the executors, one file at a time; projection by detail level,
ids, metrics and position lookups are column expressions and joins.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import spread
from ..sources.trees import Node, Tree, parse, position
from .slices import DETAIL
from .spans import innermost


@dataclass
class Entity:
    kind: str
    name: str
    start: int
    end: int
    container: str | None = None
    signature: str | None = None
    params: list[tuple[str, str]] = field(default_factory=list)
    returns: str = ""
    locals: list[tuple[str, int]] = field(default_factory=list)
    branches: list[tuple[str, int]] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    docstring: str | None = None
    fingerprint: str = ""
    anchor: int | None = None  # where comments end that belong to it: before its decorators


# -- python ----------------------------------------------------------------------------


# Branch kinds of each language.
_PY_BRANCHES = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Match: "match"}


def _py_span(node: ast.AST, starts: list[int]) -> tuple[int, int]:
    """Of a definition by itself, without its decorators."""
    return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset


def _targets(t: ast.AST) -> list[str]:
    """Names bound by a target; attribute and subscript targets bind none."""
    if isinstance(t, ast.Name):
        return [t.id]
    if isinstance(t, (ast.Tuple, ast.List)):
        return [x for e in t.elts for x in _targets(e)]
    return _targets(t.value) if isinstance(t, ast.Starred) else []


def _py_structure(node: ast.AST, lines: list[str]) -> tuple[list, list]:
    """Locals by their assignments, with its line, and branches in order; an elif is part of its if."""
    found_locals, branches = [], []
    todo = list(reversed(node.body))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(n, ast.Assign):
            found_locals += [(x, t.lineno - 1) for t in n.targets for x in _targets(t)]
        elif isinstance(n, ast.AnnAssign):
            found_locals += [(x, n.lineno - 1) for x in _targets(n.target)]
        elif_ = isinstance(n, ast.If) and lines[n.lineno - 1].encode()[n.col_offset :].startswith(b"elif")
        if type(n) in _PY_BRANCHES and not elif_:
            branches.append((_PY_BRANCHES[type(n)], n.lineno - 1))
        todo.extend(reversed(list(ast.iter_child_nodes(n))))
    return found_locals, branches


def _py_docstring(node: ast.AST, text: str) -> str | None:
    """The content of a leading string as it is written, escapes included; bytes and formatted strings are none."""
    first = node.body[0]
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None
    m = re.fullmatch(r"""[rRuU]*("{3}|'{3}|"|')((?:\\.|(?!\1).)*)\1""", ast.get_source_segment(text, first.value) or "", re.DOTALL)
    return m[2] if m else first.value.value  # strings side by side


def _py_params(a: ast.arguments, text: str) -> list[tuple[str, str]]:
    plain = [(p, "") for p in (*a.posonlyargs, *a.args)] + ([(a.vararg, "*")] if a.vararg else []) + [(p, "") for p in a.kwonlyargs] + ([(a.kwarg, "**")] if a.kwarg else [])
    # the stars belong to the name only where a type follows
    return [(stars + p.arg, tx.collapse_spaces(ast.get_source_segment(text, p.annotation))) if p.annotation else (p.arg, "") for p, stars in plain]


def _py_callable(node, kind: str, container: str | None, text: str, raw: bytes, starts: list[int]) -> Entity:
    s, e = _py_span(node, starts)
    body = _py_span(node.body[0], starts)[0]
    params = _py_params(node.args, text)
    found_locals, branches = _py_structure(node, text.split("\n"))
    returns = tx.collapse_spaces(ast.get_source_segment(text, node.returns)) if node.returns else ""
    entity = Entity(kind, node.name, s, e, container, tx.collapse_spaces(raw[s:body].decode()), params, returns, found_locals, branches, docstring=_py_docstring(node, text), fingerprint=f"function_definition:{len(params)}:{len(branches)}:1")
    return _py_decorated(entity, node, text, starts)


def _py_decorated(entity: Entity, node, text: str, starts: list[int]) -> Entity:
    entity.decorators = ["@" + tx.collapse_spaces(ast.get_source_segment(text, d)) for d in node.decorator_list]
    entity.anchor = starts[node.decorator_list[0].lineno - 1] if node.decorator_list else entity.start
    return entity


def _py_tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _python(text: str) -> list[Entity]:
    """Functions, classes and methods one level deep; functions inside functions are no entities."""
    tree = _py_tree(text)
    if tree is None:
        return []
    raw, out = text.encode(), []
    starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)]
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_py_callable(n, "Function", None, text, raw, starts))
        elif isinstance(n, ast.ClassDef):
            out.append(_py_decorated(Entity("Class", n.name, *_py_span(n, starts), fingerprint="class_definition"), n, text, starts))
            out += [_py_callable(m, "Method", n.name, text, raw, starts) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


# -- rust and typescript ---------------------------------------------------------------

# Kinds of entities by keyword, words before a declaration, words that branch.
_RUST = {"struct": ("Type", "struct_item"), "enum": ("Type", "enum_item"), "union": ("Type", "union_item"), "type": ("Type", "type_item"), "trait": ("Interface", "trait_item"), "mod": ("Module", "mod_item")}
_TS = {"class": ("Class", "class_declaration"), "interface": ("Interface", "interface_declaration"), "type": ("Type", "type_alias_declaration")}
_RUST_MODIFIERS = ("pub", "default", "async", "unsafe", "const", "extern")
_TS_MODIFIERS = ("public", "private", "protected", "static", "override", "readonly", "async", "get", "set")
_BRANCH_WORDS = {"rust": ("if", "for", "while", "match"), "typescript": ("if", "for", "while", "switch")}
_NESTED = ("fn", "function", "class", "interface", "type", "struct", "enum", "trait")
_GROUPS = ("parameters", "formal_parameters", "arguments")


def _tops(node: Node):
    """A statement's tokens and brackets; calls and paths are taken apart."""
    for c in node.children:
        if c.kind in ("call_expression", "scoped_identifier", "field_expression", "macro_invocation"):
            yield from _tops(c)
        elif c.kind != "line_comment":
            yield c


class _Head:
    """The declaration that a statement is: attributes, decorators and modifiers are passed over."""

    def __init__(self, tree: Tree, node: Node):
        self.tree, self.node, self.at = tree, node, 0
        self.tokens = list(_tops(node))
        self.decorators: list[str] = []
        self.rust = tree.language == "rust"
        self._attributes()
        self.start = self.tokens[self.at].start if self.at < len(self.tokens) else node.end
        self.modifiers = self._modifiers()

    def word(self, k: int = 0) -> str:
        return self.tree.text(self.tokens[self.at + k]) if self.at + k < len(self.tokens) and not self.tokens[self.at + k].children else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.at + k].kind if self.at + k < len(self.tokens) else ""

    def _attributes(self) -> None:
        while self.rust and self.word() == "#":
            self.at += 1 + (self.word(1) == "!")
            self.at += self.kind() == "brackets"
        while not self.rust and self.word() == "@":
            first = self.tokens[self.at]
            self.at += 2
            while self.word() == ".":
                self.at += 2
            self.at += self.kind() in _GROUPS
            self.decorators.append(tx.collapse_spaces(self.tree.source[first.start : self.tokens[self.at - 1].end].decode(errors="replace")))

    def _modifiers(self) -> list[str]:
        out = []
        while self.rust and self.word() in _RUST_MODIFIERS and not (self.word() == "const" and self.word(1) not in ("fn", "async", "unsafe", "extern")):
            out.append(self.word())
            self.at += 1
            self.at += self.kind() in _GROUPS + ("string_literal",)
        if not self.rust and self.word() == "async" and self.word(1) == "function":
            out.append("async")
            self.at += 1
        return out

    def generics(self) -> None:
        """Passes over what stands in angle brackets."""
        depth = 0
        while self.at < len(self.tokens):
            depth += (self.word() == "<") - (self.word() == ">")
            if depth <= 0 and self.word() != ">":
                return
            self.at += 1
            if depth <= 0:
                return

    def callable(self, kind: str, name: str, container: str | None, fingerprint: str, starts: list[int]) -> Entity | None:
        """From the place after the name: parameters, the type after them, the body; null where there are no parameters or a method has no body."""
        self.generics()
        if self.kind() not in _GROUPS:
            return None
        group = self.tokens[self.at]
        body = next((t for t in self.tokens[self.at + 1 :] if t.kind == "block"), None)
        if body is None and (kind == "Method" or self.rust):
            return None
        source, head_end = self.tree.source, body.start if body else self.node.end
        params = [x for part in _split(source[group.start + 1 : group.end - 1].decode(errors="replace"), self.rust) if (x := _param(part, self.rust))]
        tail = re.split(r"\bwhere\b", source[group.end : head_end].decode(errors="replace"))[0].strip().rstrip(";").rstrip()
        returns = tx.collapse_spaces(tail.removeprefix("->")) if self.rust else tx.collapse_spaces(tail)
        found, branches = _brace_structure(self.tree, body, starts) if body else ([], [])
        signature = tx.collapse_spaces(source[self.start : head_end].decode(errors="replace"))
        return Entity(kind, name, self.start, self.node.end, container, signature, params, returns, found, branches, fingerprint=f"{fingerprint}:{len(params)}:{len(branches)}:{int(body is not None)}")


def _outer(text: str, rust: bool):
    """(place, character) of what is outside brackets and strings; arrows are no brackets."""
    depth, quote = 0, ""
    for k, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and text[k - 1] != "\\" else quote
            continue
        if ch in ('"' if rust else "\"'`"):
            quote = ch
            continue
        arrow = ch == ">" and k > 0 and text[k - 1] in "=-"
        depth -= ch in ")]}>" and not arrow
        if depth == 0:
            yield k, ch
        depth += ch in "([{<"


def _split(text: str, rust: bool) -> list[str]:
    """At commas outside brackets."""
    cuts = [k for k, ch in _outer(text, rust) if ch == ","]
    parts = [text[a:b].strip() for a, b in zip([0] + [k + 1 for k in cuts], cuts + [len(text)])]
    return [p for p in parts if p]


def _param(part: str, rust: bool) -> tuple[str, str] | None:
    """Name and type; a type of TypeScript has its colon, a receiver of Rust is none."""
    if rust:
        colon = next((k for k, ch in _outer(part, rust) if ch == ":" and part[k : k + 2] != "::" and part[k - 1 : k] != ":"), None)
        name = re.sub(r"^mut\s+", "", part[:colon].strip())
        if colon is None and re.fullmatch(r"(&\s*('\w+\s*)?)?(mut\s+)?self", part):
            return None
        return tx.collapse_spaces(name), tx.collapse_spaces(part[colon + 1 :]) if colon is not None else ""
    part = re.sub(r"^(@[\w.]+(\([^()]*\))?\s*)+", "", part)
    part = re.sub(r"^(?:(?:public|private|protected|readonly|override)\s+)+", "", part)
    equals = next((k for k, ch in _outer(part, rust) if ch == "=" and part[k + 1 : k + 2] != ">"), len(part))
    colon = next((k for k, ch in _outer(part, rust) if ch == ":" and k < equals), equals)
    return tx.collapse_spaces(part[:colon].strip().rstrip("?")), tx.collapse_spaces(part[colon:equals])


def _bound(tree: Tree, tokens: list[Node]) -> list[str]:
    """Names that a pattern binds: not the keys before a colon, nor defaults."""
    words = [(tree.text(t), t) if not t.children else ("", t) for t in tokens]
    out = []
    for k, (w, t) in enumerate(words):
        if t.children:
            out += _bound(tree, list(_tops(t)))
        elif t.kind == "identifier" and w not in ("mut", "ref") and (k == 0 or words[k - 1][0] != "=") and not (k + 1 < len(words) and words[k + 1][0] in (":", "::")):
            out.append(w)
    return out


def _declared_names(tree: Tree, tokens: list[Node]) -> list[str]:
    """Of a declaration's tokens after its keyword, the names before each type or value."""
    out, now, open_ = [], [], True
    for t in tokens:
        w = tree.text(t) if not t.children else ""
        if w in (":", "=", ";"):
            open_ = False
        elif w == "," and tree.language == "typescript":
            out, now, open_ = out + _bound(tree, now), [], True
        elif open_:
            now.append(t)
    return out + _bound(tree, now)


def _brace_structure(tree: Tree, body: Node, starts: list[int]) -> tuple[list, list]:
    """Locals by their declarations, branches by their words; declarations inside are passed over."""
    found, branches = [], []
    keywords = ("let",) if tree.language == "rust" else ("let", "const")
    todo = list(reversed(body.children))
    before = ""
    while todo:
        n = todo.pop()
        if not n.children:
            w = tree.text(n) if n.kind == "identifier" else ""
            if w in _BRANCH_WORDS[tree.language] and before != ".":
                branches.append((w, position(starts, n.start)[0]))
            before = w or n.kind
            continue
        if n.kind.endswith(("_item", "_statement", "_declaration", "_expression")) or n.kind == "arguments" and before == "for":
            tokens = list(_tops(n))
            if n.kind == "arguments":  # a for with a declaration and a condition; one over values declares nothing
                tokens = tokens[1:] if any(tree.text(t) == ";" for t in tokens if not t.children) else []
            elif n.kind != "call_expression":
                head = _Head(tree, n)
                if head.word() in _NESTED and head.kind(1) == "identifier":
                    continue
            if tokens and not tokens[0].children and tree.text(tokens[0]) in keywords:
                row = position(starts, tokens[0].start)[0]
                found += [(name, row) for name in _declared_names(tree, tokens[1:])]
        todo.extend(reversed(n.children))
    return found, branches


def _brace(text: str, language: str) -> list[Entity]:
    """What stands at the top of a file, and methods one level deep. Exported, declared and abstract declarations of TypeScript, and generators, are no entities."""
    tree = parse(text, language)
    starts, out, decorators = tree.line_starts(), [], []
    for n in tree.root.children:
        if not n.children:
            continue
        head = _Head(tree, n)
        if not head.rust and head.at >= len(head.tokens):  # decorators on lines of their own
            decorators.append((head.decorators, n.start))
            continue
        if decorators:
            head.decorators, head.start = [d for ds, _ in decorators for d in ds] + head.decorators, decorators[0][1]
            decorators = []
        elif head.decorators:
            head.start = n.start
        word, known = head.word(), _RUST if head.rust else _TS
        if word in ("fn", "function") and head.kind(1) == "identifier":
            name = head.word(1)
            head.at += 2
            if e := head.callable("Function", name, None, "function_item" if head.rust else "function_declaration", starts):
                out.append(e)
        elif word in known and head.kind(1) == "identifier":
            kind, fingerprint = known[word]
            e = Entity(kind, head.word(1), head.start, n.end, decorators=head.decorators if kind == "Class" else [], fingerprint=fingerprint)
            e.anchor = e.start
            out.append(e)
            if word in ("trait", "class"):
                out += _members(tree, n, e.name, starts)
        elif head.rust and word == "impl":
            head.at += 1
            head.generics()
            end = next((t.start for t in head.tokens if t.kind == "block"), n.end)
            first = head.tokens[head.at].start if head.at < len(head.tokens) else end
            target = re.split(r"\bwhere\b", tree.source[first:end].decode(errors="replace"))[0]
            out += _members(tree, n, tx.collapse_spaces(re.split(r"\bfor\b(?!\s*<)", target)[-1]), starts)
    return sorted(out, key=lambda e: e.start)


def _members(tree: Tree, node: Node, container: str, starts: list[int]) -> list[Entity]:
    body = next((c for c in node.children if c.kind == "block"), None)
    out = []
    for c in body.children if body else []:
        if not c.children:
            continue
        head = _Head(tree, c)
        if head.rust:
            if head.word() != "fn":
                continue
            name, head.at = head.word(1), head.at + 2
        else:
            while head.word() in _TS_MODIFIERS and head.kind(1) not in _GROUPS and head.word(1) not in ("<", "=", ":", ";") or head.word() == "*":
                head.at += 1
            private = head.word() == "#"
            name, head.at = ("#" + head.word(1), head.at + 2) if private else (head.word(), head.at + 1)
            head.at += head.word() == "?"
        if name and (e := head.callable("Method", name, container, "function_item" if head.rust else "method_definition", starts)):
            out.append(e)
    return out


# -- attachments and imports -----------------------------------------------------------

# What comment lines begin with, tried in this order.
_COMMENT = {"python": ("#",), "rust": ("///", "//!", "/**", "/*!", "//", "*/", "*"), "typescript": ("/**", "/*", "*/", "*", "//")}
_IMPORT = re.compile(r"^(import|from)\s")


def leading_comments(lines: list[str], row: int, language: str) -> list[str]:
    """Comment lines right above a row, without their marks; a blank line ends them, and so does an empty comment but in Python."""
    out, k = [], row - 1
    while k >= 0:
        line = lines[k].strip()
        mark = next((m for m in _COMMENT[language] if line.startswith(m)), None)
        if mark is None:
            break
        body = line[len(mark) :].strip()
        if language != "python":
            body = body.removesuffix("*/").strip()
            if not body:
                break
        out.append(body)
        k -= 1
    return out[::-1]


def _import_spans(text: str, language: str) -> list[tuple[int, int]]:
    """Byte spans of a file's top imports. A Python file that doesn't parse has those lines that begin like one."""
    raw = text.encode()
    starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)]
    if language != "python":
        tree = parse(text, language)
        heads = [_Head(tree, n) for n in tree.root.children if n.children]
        if language == "rust":
            return [(h.start, h.node.end) for h in heads if h.word() == "use" or h.modifiers[-1:] == ["extern"] and h.word() == "crate"]
        # names in braces end a statement of these trees: what follows them is the rest of the import
        ends = [after.node.end if after and after.word() == "from" else h.node.end for h, after in zip(heads, heads[1:] + [None])]
        return [(h.start, end) for h, end in zip(heads, ends) if h.word() == "import" and h.kind(1) not in ("arguments", ".")]
    tree = _py_tree(text)
    if tree is None:
        return [(starts[k], starts[k] + len(x.encode())) for k, x in enumerate(text.split("\n")) if _IMPORT.match(x)]
    return [_py_span(n, starts) for n in tree.body if isinstance(n, ast.Import) or isinstance(n, ast.ImportFrom) and n.module != "__future__"]


def _import_name(text: str, language: str) -> str:
    if language == "rust":
        text = re.sub(r"^(use |extern crate )+", "", re.sub(r"^pub(\s+|\([^)]*\)\s*)", "", text))
    else:
        text = re.sub(r"^(from )*(import )*" if language == "python" else r"^(import )+", "", text)
    return (text if language == "python" else text.rstrip(";")).strip()


def import_block(text: str, language: str) -> tuple[int, int, list[str]] | None:
    """Bytes of the first run of imports on rows that follow each other, and their names."""
    raw = text.encode()
    starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)]
    run: list[tuple[int, int]] = []
    for s, e in _import_spans(text, language):
        if run and position(starts, s)[0] > position(starts, run[-1][1])[0] + 1:
            break
        run.append((s, e))
    if not run:
        return None
    return run[0][0], run[-1][1], [_import_name(raw[s:e].decode(errors="replace"), language) for s, e in run]


ENTITY_SCHEMA = (
    "uri string, lang string, ord int, kind string, name string, container string, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long, signature string, "
    "params array<struct<name:string,type:string>>, returns string, locals array<struct<name:string,decl_line:long>>, branches array<struct<kind:string,line:long>>, decorators array<string>, docstring string, comments array<string>, fingerprint string, imports array<string>"
)
_PAIR = lambda a, b, kind: pa.list_(pa.struct([(a, pa.string()), (b, kind)]))
_ENTITY_KINDS = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 6, pa.string(), _PAIR("name", "type", pa.string()), pa.string(), _PAIR("name", "decl_line", pa.int64()), _PAIR("kind", "line", pa.int64()), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
_ENTITY_NAMES = ["uri", "lang", "ord", "kind", "name", "container", "start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column", "signature", "params", "returns", "locals", "branches", "decorators", "docstring", "comments", "fingerprint", "imports"]


def extract(text: str, language: str) -> list[Entity]:
    return _python(text) if language == "python" else _brace(text, language)


def _rows(uri: str, language: str, text: str) -> list[tuple]:
    raw = text.encode()
    starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)]
    lines, out = text.split("\n"), []
    block = import_block(text, language)
    imports = block[2] if block else []
    for k, e in enumerate(extract(text, language)):
        (r0, c0), (r1, c1) = position(starts, e.start), position(starts, e.end)
        above = position(starts, e.start if e.anchor is None else e.anchor)[0]
        struct = lambda a, b, xs: [{a: x, b: y} for x, y in xs]
        out.append((uri, language, k, e.kind, e.name, e.container, e.start, e.end, r0, c0, r1, c1, e.signature, struct("name", "type", e.params), e.returns, struct("name", "decl_line", e.locals), struct("kind", "line", e.branches), e.decorators, e.docstring, leading_comments(lines, above, language), e.fingerprint, imports))
    if block:  # the module is the whole file, but is reached through its imports only
        name = uri.replace("\\", "/").rsplit("/", 1)[-1]
        ends = lines[:-1] if lines[-1] == "" else lines
        out.append((uri, language, len(out), "Module", name.rsplit(".", 1)[0] or name, None, block[0], block[1], 0, 0, len(ends) - 1, len(ends[-1].rstrip("\r").encode()), None, [], "", [], [], [], None, [], "module", imports))
    return out


def entities(sources: DataFrame) -> DataFrame:
    """sources (uri, lang, text) to a row for each entity; unknown languages have none."""

    def run(batches):
        for batch in batches:
            rows = [r for u, g, t in zip(*(batch.column(c).to_pylist() for c in ("uri", "lang", "text"))) if g in _COMMENT for r in _rows(u, g, t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _ENTITY_KINDS)], names=_ENTITY_NAMES)

    return spread(sources.select("uri", "lang", "text")).mapInArrow(run, ENTITY_SCHEMA)


def symbol_id() -> Column:
    """Of an entity row: language, kind, name, container, parameters, returns, structure and path, each with its length before it."""
    field_text = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    empty = F.lit("")
    params = F.array_join(F.flatten(F.transform("params", lambda p: F.array(field_text(p["name"]), field_text(F.coalesce(p["type"], empty))))), "")
    parts = [field_text(F.coalesce(F.col(c), empty)) for c in ("lang", "kind", "name", "container")]
    parts += [F.coalesce(params, empty), *(field_text(F.coalesce(F.col(c), empty)) for c in ("returns", "fingerprint")), field_text(tx.path_hint("uri"))]
    return F.concat(F.lit("sym_"), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16))


def cards(found: DataFrame, detail: str = "structure", fan: DataFrame | None = None) -> DataFrame:
    """Entity rows to cards: sub-records above the detail level are null, so their columns are pruned.

    fan (id, fan_in, fan_out): counts of a call graph whose ids are symbol ids.
    """
    level = DETAIL.index(detail)
    at = lambda k, c: F.when(F.lit(level >= k), c)
    rows = found.withColumn("symbol_id", symbol_id())
    if fan is not None:
        rows = rows.join(fan.withColumnRenamed("id", "__id"), F.col("symbol_id") == F.col("__id"), "left").drop("__id")
    else:
        rows = rows.withColumns({"fan_in": F.lit(None).cast("long"), "fan_out": F.lit(None).cast("long")})
    doc = F.coalesce("docstring", F.when(F.size("comments") > 0, F.array_join("comments", "\n")))
    plain = F.transform("decorators", tx.decorator_name)
    attached = F.struct(F.col("comments").alias("doc_comments"), "decorators", F.struct(plain.alias("decorators")).alias("normalized"), F.lit("leading_trivia").alias("bundle_rule"))
    sources = [F.lit(x) for k, x in enumerate(("tree_sitter", "tree_sitter_degraded_semantic", "tree_sitter_degraded_full")) if k == 0 or level >= k + 2]
    span = F.struct(F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column")).alias("start"), F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("end"))
    return rows.select(
        F.struct("symbol_id", "lang", "kind", "name", "container", "uri", span.alias("range")).alias("symbol"),
        at(1, F.when(F.col("signature").isNotNull(), F.struct("signature", "params", "returns"))).alias("signature"),
        at(2, F.when(doc.isNotNull(), F.struct(doc.alias("docstring"), F.coalesce(tx.summary(doc), F.lit("")).alias("summary"), F.lit("tree_sitter").alias("source")))).alias("doc"),
        at(2, F.when((F.size("comments") > 0) | (F.size("decorators") > 0), attached)).alias("attachments"),
        at(2, F.struct("locals", "branches")).alias("structure"),
        at(2, F.struct((F.col("end_line") - F.col("start_line") + 1).alias("lines"), (F.size("branches") + 1).alias("cyclomatic"), "fan_in", "fan_out")).alias("metrics"),
        F.when(F.col("kind") == "Module", F.struct(F.col("imports").alias("normalized"), F.array("imports").alias("groups"))).alias("interstitial"),
        F.lit(None).cast("string").alias("deps"),
        F.array(*sources).alias("provenance"),
        F.col("symbol_id").alias("etag"),
    )


def entity_at(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (uri, at: byte) with the innermost entity there; the import block counts only where no entity is."""
    own, module = found.filter("kind <> 'Module'"), found.filter("kind = 'Module'")
    hit = innermost(points, own)
    missing = hit.filter("name is null").select(*points.columns)
    return hit.filter("name is not null").unionByName(innermost(missing, module))
