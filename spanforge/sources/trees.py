"""Tree providers: source text to syntax trees, and trees to interval-encoded node rows.

Providers: python (the standard parser's tree, with its tokens as anonymous leaves), rust
and typescript (a bracket, statement and call tree over tokens; errors are unbalanced
brackets), html (elements and text), prose (lines, sentences, words). Kind names follow
common grammars where the providers can tell them, but they are these providers' own.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import spread


@dataclass
class Node:
    kind: str
    start: int
    end: int
    named: bool = True
    children: list[Node] = field(default_factory=list)
    error: bool = False
    missing: bool = False

    def named_children(self) -> list[Node]:
        return [c for c in self.children if c.named]

    def walk(self) -> Iterator[Node]:
        """Pre-order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))


@dataclass
class Tree:
    root: Node
    source: bytes
    language: str

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end].decode(errors="replace")

    def has_errors(self) -> bool:
        return any(n.error or n.missing for n in self.root.walk())

    def line_starts(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer(rb"\n", self.source)]


def position(starts: list[int], byte: int) -> tuple[int, int]:
    """0-based row and byte column of a byte offset."""
    row = bisect.bisect_right(starts, byte) - 1
    return row, byte - starts[row]


# -- python ----------------------------------------------------------------------------

# Kinds of nodes, by the standard parser's class names.
_PY_KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Expr": "expression_statement",
    "Call": "call", "Name": "identifier", "Attribute": "attribute", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment",
    "Return": "return_statement", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "With": "with_statement",
    "AsyncWith": "with_statement", "Try": "try_statement", "Match": "match_statement", "match_case": "case_clause", "Raise": "raise_statement", "Assert": "assert_statement", "Delete": "delete_statement",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Pass": "pass_statement",
    "Break": "break_statement", "Continue": "continue_statement", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "BoolOp": "boolean_operator",
    "Compare": "comparison_operator", "Lambda": "lambda", "IfExp": "conditional_expression", "Dict": "dictionary", "Set": "set", "List": "list", "Tuple": "tuple",
    "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "Await": "await",
    "Yield": "yield", "YieldFrom": "yield", "JoinedStr": "string", "Subscript": "subscript", "Starred": "list_splat", "NamedExpr": "named_expression", "Slice": "slice",
    "arg": "typed_parameter", "keyword": "keyword_argument", "alias": "dotted_name", "ExceptHandler": "except_clause", "withitem": "with_item",
}
_PY_SKIP = (tokenize.ENCODING, tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)

_PY_TOKENS = {tokenize.NAME: "identifier", tokenize.NUMBER: "number", tokenize.STRING: "string", tokenize.COMMENT: "comment"}


def _python(text: str) -> Node:
    raw = text.encode()
    lines = [0] + [m.end() for m in re.finditer(rb"\n", raw)]
    chars = text.split("\n")
    try:
        tree = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, tokenize.TokenError, ValueError, RecursionError) as e:
        row = min(max((getattr(e, "lineno", 1) or 1) - 1, 0), len(lines) - 1)
        end = lines[row + 1] if row + 1 < len(lines) else len(raw)
        return Node("module", 0, len(raw), children=[Node("ERROR", lines[row], end, error=True)])
    plain = text.isascii()
    at = lambda row, col: lines[row - 1] + (col if plain else len(chars[row - 1][:col].encode()))
    leaves = []
    for t in tokens:
        if t.type not in _PY_SKIP and t.string:
            kind = _PY_TOKENS.get(t.type, t.string)
            leaves.append(Node(kind, at(*t.start), at(*t.end), named=t.type == tokenize.COMMENT))
    leaves = [n for n in leaves if n.end > n.start]
    starts = [n.start for n in leaves]

    def span(n: ast.AST) -> tuple[int, int] | None:
        if not hasattr(n, "lineno") or n.end_lineno is None:
            return None
        s, e = lines[n.lineno - 1] + n.col_offset, lines[n.end_lineno - 1] + n.end_col_offset
        for d in getattr(n, "decorator_list", []):
            s = min(s, raw.rfind(b"@", 0, lines[d.lineno - 1] + d.col_offset))
        return s, e

    def constant(n: ast.Constant) -> str:
        v = n.value
        return "string" if isinstance(v, (str, bytes)) else {True: "true", False: "false", None: "none"}[v] if v is None or isinstance(v, bool) else "ellipsis" if v is ... else "integer" if isinstance(v, int) else "float"

    def group(kind: str, inner: list[Node], s: int, e: int) -> Node:
        return Node(kind, s, e, children=fill(inner, s, e))

    def fill(inner: list[Node], s: int, e: int) -> list[Node]:
        """inner with the tokens between them as anonymous leaves."""
        out, cursor = [], s
        for c in [*sorted(inner, key=lambda c: (c.start, -c.end)), None]:
            stop = c.start if c else e
            k = bisect.bisect_left(starts, cursor)
            while k < len(leaves) and leaves[k].end <= stop:
                out.append(leaves[k])
                k += 1
            if c:
                out.append(c)
                cursor = c.end
        return out

    def flat(n: ast.AST) -> list[Node]:
        found = []
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                continue
            found += [build(c)] if span(c) else flat(c)
        return found

    def build(n: ast.AST) -> Node:
        s, e = span(n)
        name = type(n).__name__
        if isinstance(n, ast.Constant):
            return Node(constant(n), s, e)
        if isinstance(n, (ast.Name, ast.JoinedStr)) or isinstance(n, ast.arg) and n.annotation is None:
            return Node(_PY_KINDS[name], s, e)
        kind, inner = _PY_KINDS.get(name, name.lower()), flat(n)
        if isinstance(n, ast.Call):
            f = inner[0]  # what is called comes first; built once, else chains of calls would double at each link
            open_at = raw.index(b"(", f.end)
            inner = [f, group("argument_list", [c for c in inner if c.start > open_at], open_at, e)]
        elif isinstance(n, ast.Attribute):
            end = n.value.end_lineno, n.value.end_col_offset
            after = lines[end[0] - 1] + end[1]
            k = e - len(n.attr.encode())
            if k >= after:
                inner.append(Node("identifier", k, e))
        elif hasattr(n, "body") and isinstance(n.body, list) and n.body:
            inner = blocks(n, inner, s, e)
        if decorators := getattr(n, "decorator_list", []):
            floor = max(span(d)[1] for d in decorators)
            start = next(x.start for x in leaves[bisect.bisect_left(starts, floor) :] if not x.named)
            node = Node(kind, start, e, children=fill([c for c in inner if c.start >= start], start, e))
            return Node("decorated_definition", s, e, children=fill([*(c for c in inner if c.start < start), node], s, e))
        return Node(kind, s, e, children=fill(inner, s, e))

    def blocks(n: ast.AST, inner: list[Node], s: int, e: int) -> list[Node]:
        groups = []
        for part in ("body", "orelse", "finalbody"):
            body = [x for x in getattr(n, part, None) or [] if isinstance(x, ast.stmt) and span(x)]
            if body:
                groups.append((min(span(x)[0] for x in body), max(span(x)[1] for x in body)))
        rest = [c for c in inner if not any(a <= c.start and c.end <= b for a, b in groups)]
        out = rest + [group("block", [c for c in inner if a <= c.start and c.end <= b], a, b) for a, b in groups]
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            word = "class" if isinstance(n, ast.ClassDef) else "def"
            floor = max((span(d)[1] for d in n.decorator_list), default=s)
            k = next(i for i in range(bisect.bisect_left(starts, floor), len(leaves)) if raw[leaves[i].start : leaves[i].end] == word.encode())
            name = leaves[k + 1]
            out.append(Node("identifier", name.start, name.end))
            if word == "def":
                depth, j = 0, k + 2
                while raw[leaves[j].start : leaves[j].start + 1] != b"(":
                    j += 1
                first = j
                while True:
                    x = raw[leaves[j].start : leaves[j].end]
                    depth += (x in (b"(", b"[", b"{")) - (x in (b")", b"]", b"}"))
                    if not depth:
                        break
                    j += 1
                a, b = leaves[first].start, leaves[j].end
                out = [c for c in out if not (a <= c.start and c.end <= b)] + [group("parameters", [c for c in out if a <= c.start and c.end <= b], a, b)]
        return out

    root = Node("module", 0, len(raw))
    root.children = fill(flat(tree), 0, len(raw))
    return root


# -- rust and typescript ---------------------------------------------------------------

_BRACE_TOKEN = re.compile(
    rb"""(?P<skip>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>(?:b|r|br)?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)|(?P<char>'(?:\\.[^']*|[^'\\])')|(?P<text>'(?:\\.|[^'\\\n])*'(?![A-Za-z_]))|(?P<life>'[A-Za-z_]\w*)
    |(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<op>->|=>|::|\.\.\.|\.\.=?|[-+*/%&|^!=<>]=|&&|\|\||\?\.|\?\?|[^\s\w])""",
    re.DOTALL | re.VERBOSE,
)
_CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}
_GROUP = {b"(": "arguments", b"[": "brackets", b"{": "block"}
# Leading keywords of declarations.
_ITEMS = {
    "rust": {b"fn": "function_item", b"struct": "struct_item", b"enum": "enum_item", b"union": "union_item", b"type": "type_item", b"trait": "trait_item", b"impl": "impl_item", b"mod": "mod_item", b"use": "use_declaration", b"let": "let_declaration", b"if": "if_expression", b"for": "for_expression", b"while": "while_expression", b"loop": "loop_expression", b"match": "match_expression", b"return": "return_expression", b"const": "const_item", b"static": "static_item"},
    "typescript": {b"function": "function_declaration", b"class": "class_declaration", b"interface": "interface_declaration", b"type": "type_alias_declaration", b"import": "import_statement", b"export": "export_statement", b"let": "lexical_declaration", b"const": "lexical_declaration", b"var": "variable_declaration", b"if": "if_statement", b"for": "for_statement", b"while": "while_statement", b"switch": "switch_statement", b"return": "return_statement", b"enum": "enum_declaration"},
}
_MODIFIERS = {b"pub", b"async", b"unsafe", b"default", b"declare", b"abstract", b"extern"}


def _brace(text: str, language: str) -> Node:
    raw = text.encode()
    items = _ITEMS[language]
    root = Node("source_file" if language == "rust" else "program", 0, len(raw))
    stack: list[tuple[Node, bytes]] = [(root, b"")]
    at = 0
    while at < len(raw):
        m = _BRACE_TOKEN.match(raw, at)
        if not m:
            stack[-1][0].children.append(Node("ERROR", at, at + 1, error=True))
            at += 1
            continue
        at, value, kind = m.end(), m[0], m.lastgroup
        if kind == "skip":
            continue
        top = stack[-1][0]
        if value in _CLOSE:
            node = Node(_GROUP[value], m.start(), m.end(), children=[Node(value.decode(), m.start(), m.end(), named=False)])
            top.children.append(node)
            stack.append((node, value))
        elif value in (b")", b"]", b"}"):
            if len(stack) > 1 and _CLOSE[stack[-1][1]] == value:
                top.children.append(Node(value.decode(), m.start(), m.end(), named=False))
                top.end = m.end()
                stack.pop()
            else:
                top.children.append(Node("ERROR", m.start(), m.end(), error=True))
        else:
            names = {"comment": "line_comment", "string": "string_literal", "text": "string_literal", "char": "char_literal", "life": "lifetime", "number": "number", "name": "identifier"}
            top.children.append(Node(names.get(kind, value.decode(errors="replace")), m.start(), m.end(), named=kind != "op"))
    while len(stack) > 1:
        node, opener = stack.pop()
        node.end = len(raw)
        node.children.append(Node(_CLOSE[opener].decode(), len(raw), len(raw), named=False, missing=True))
    _shape(root, raw, items, True)
    return root


def _shape(node: Node, raw: bytes, items: dict, statements: bool) -> None:
    """Joins calls and macros, then cuts blocks into statements."""
    for c in node.children:
        if c.kind in ("arguments", "brackets", "block"):
            _shape(c, raw, items, c.kind == "block")
    out: list[Node] = []
    for c in node.children:
        macro = len(out) > 1 and out[-1].kind == "!" and out[-2].kind == "identifier" and c.kind in ("arguments", "brackets")
        if macro:
            c.kind = "token_tree"
            bang, name = out.pop(), out.pop()
            out.append(Node("macro_invocation", name.start, c.end, children=[name, bang, c]))
        elif c.kind == "arguments" and out and out[-1].end == c.start and (out[-1].kind in ("identifier", "call_expression", "field_expression")) and raw[out[-1].start : out[-1].end] not in items and not (len(out) > 1 and raw[out[-2].start : out[-2].end] in (b"fn", b"function")):
            f = out.pop()
            out.append(Node("call_expression", f.start, c.end, children=[f, c]))
        elif c.kind == "identifier" and len(out) > 1 and out[-1].kind in (".", "::") and out[-2].named and out[-2].kind not in ("block", "line_comment"):
            dot, left = out.pop(), out.pop()
            out.append(Node("field_expression" if dot.kind == "." else "scoped_identifier", left.start, c.end, children=[left, dot, c]))
        else:
            if c.kind == "arguments" and len(out) > 1 and raw[out[-2].start : out[-2].end] in (b"fn", b"function"):
                c.kind = "parameters" if b"fn" == raw[out[-2].start : out[-2].end] else "formal_parameters"
            out.append(c)
    node.children = _statements(out, raw, items) if statements else out


def _statements(children: list[Node], raw: bytes, items: dict) -> list[Node]:
    out: list[Node] = []
    now: list[Node] = []

    def close():
        if not now:
            return
        first = next((n for n in now if raw[n.start : n.end] not in _MODIFIERS and n.kind != "arguments"), now[0])
        word = raw[first.start : first.end] if first.kind == "identifier" else b""
        kind = items.get(word)
        body = [n for n in now if n.kind != ";"]
        if kind is None and len(body) == 1 and len(now) == 1 and not body[0].named:
            out.append(body[0])
        elif kind is None and len(now) == 1 and body and body[0].kind in ("block", "line_comment"):
            out.append(body[0])
        else:
            out.append(Node(kind or "expression_statement", now[0].start, now[-1].end, children=list(now)))
        now.clear()

    for k, c in enumerate(children):
        if c.kind in ("{", "}") and not c.named or c.kind == "line_comment" and not now:
            close()
            out.append(c)
            continue
        now.append(c)
        following = children[k + 1] if k + 1 < len(children) else None
        if c.kind == ";" or c.kind == "block" and not (following is not None and raw[following.start : following.end] in (b"else", b".", b")", b";", b",", b"?")) or (following is not None and b"\n" in raw[c.end : following.start] and items is _ITEMS["typescript"] and following.named and c.named and following.kind != "block"):
            close()
    close()
    return out


# -- html and prose --------------------------------------------------------------------

# Elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


_REFERENCE = re.compile(r"&#?[0-9A-Za-z]*;?")


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.bytes = None if text.isascii() else [0]
        if self.bytes is not None:
            for ch in text:
                self.bytes.append(self.bytes[-1] + len(ch.encode()))
        self.root = Node("document", 0, self.at(len(text)))
        self.stack = [self.root]
        self.names = [""]
        self.feed(text)
        self.close()
        end = self.root.end
        while len(self.stack) > 1:
            self.stack.pop().end = end

    def at(self, k: int) -> int:
        return k if self.bytes is None else self.bytes[k]

    def here(self) -> int:
        row, col = self.getpos()
        return self.starts[row - 1] + col

    def handle_starttag(self, tag, attrs):
        s = self.here()
        e = s + len(self.get_starttag_text())
        node = Node("element", self.at(s), self.at(e))
        opening = Node("start_tag", self.at(s), self.at(e), children=[Node("tag_name", self.at(s + 1), self.at(s + 1 + len(tag)))])
        if rest := self.text[s + 1 + len(tag) : e].rstrip(">").rstrip("/").strip():
            k = self.text.index(rest, s + 1 + len(tag))
            opening.children.append(Node("attributes", self.at(k), self.at(k + len(rest))))
        node.children.append(opening)
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)
            self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.stack.pop()
            self.names.pop()

    def handle_endtag(self, tag):
        s = self.here()
        e = self.text.find(">", s) + 1 or len(self.text)
        if tag not in self.names:
            self.stack[-1].children.append(Node("ERROR", self.at(s), self.at(e), error=True))
            return
        while self.names[-1] != tag:
            self.stack.pop().end = self.at(s)
            self.names.pop()
        node = self.stack.pop()
        self.names.pop()
        node.children.append(Node("end_tag", self.at(s), self.at(e)))
        node.end = self.at(e)

    def piece(self, length: int, blank: bool = False) -> None:
        """Text of the source as it stands; pieces without a gap are one text."""
        s = self.here()
        kids = self.stack[-1].children
        if kids and kids[-1].kind == "text" and kids[-1].end == self.at(s):
            kids[-1].end = self.at(s + length)
        elif not blank:
            kids.append(Node("text", self.at(s), self.at(s + length)))

    def handle_data(self, data):
        self.piece(len(data), not data.strip())

    def handle_entityref(self, name):
        self.piece(_REFERENCE.match(self.text, self.here()).end() - self.here())

    handle_charref = handle_entityref

    def handle_comment(self, data):
        s = self.here()
        self.stack[-1].children.append(Node("comment", self.at(s), self.at(min(s + len(data) + 7, len(self.text)))))


def _prose(text: str, lines_only: bool = False) -> Node:
    raw = text.encode()
    root = Node("document", 0, len(raw))
    for line in re.finditer(rb"[^\n]+", raw):
        node = Node("line", line.start(), line.end())
        for s in re.finditer(rb"[^.!?]+[.!?]*", b"" if lines_only else line[0]):
            if s[0].strip():
                sentence = Node("sentence", line.start() + s.start(), line.start() + s.end())
                sentence.children = [Node("word", line.start() + s.start() + w.start(), line.start() + s.start() + w.end()) for w in re.finditer(rb"[^\s]+", s[0])]
                node.children.append(sentence)
        root.children.append(node)
    return root


PROVIDERS = {
    "python": _python,
    "rust": lambda t: _brace(t, "rust"),
    "typescript": lambda t: _brace(t, "typescript"),
    "html": lambda t: _Html(t).root,
    "prose": _prose,
}


def parse(text: str, language: str) -> Tree:
    if language not in PROVIDERS:
        raise ValueError(f"no tree provider for {language}")
    return Tree(PROVIDERS[language](text), text.encode(), language)


NODE_SCHEMA = "uri string, node_id long, parent_id long, ord int, kind string, named boolean, start_byte long, end_byte long, start_row long, start_col long, end_row long, end_col long, subtree_last_id long, is_error boolean, is_missing boolean, text string"
_NODE_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.bool_(), pa.bool_(), pa.string()]


def node_rows(uri: str, tree: Tree) -> Iterator[tuple]:
    """Pre-order rows; a subtree is the id range from a node to its subtree_last_id. Only leaves carry text."""
    starts, ids = tree.line_starts(), 0
    rows: list[list] = []
    todo: list[tuple[Node | None, int | None, int]] = [(tree.root, None, 0)]
    while todo:
        node, parent, ord_ = todo.pop()
        if node is None:
            rows[parent][12] = ids - 1
            continue
        (r0, c0), (r1, c1) = position(starts, node.start), position(starts, node.end)
        rows.append([uri, ids, parent, ord_, node.kind, node.named, node.start, node.end, r0, c0, r1, c1, ids, node.error, node.missing, None if node.children else tree.text(node)])
        todo.append((None, ids, 0))
        todo.extend((c, ids, k) for k, c in reversed(list(enumerate(node.children))))
        ids += 1
    return (tuple(r) for r in rows)


def nodes(sources: DataFrame, language: str, kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """sources (uri, text) to node rows; of the given kinds and columns only, which saves building the rest."""
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    wanted = names if columns is None else list(columns)
    at = [names.index(c) for c in wanted]
    schema = ", ".join(NODE_SCHEMA.split(", ")[k] for k in at)
    # lines alone need no sentences and words, whose number only shows in ids
    lines_only = language == "prose" and kinds is not None and set(kinds) <= {"document", "line"} and not {"node_id", "parent_id", "subtree_last_id", "text"} & set(wanted)

    def run(batches):
        for batch in batches:
            held: list[list] = [[] for _ in at]
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist()):
                tree = Tree(_prose(text or "", True), (text or "").encode(), language) if lines_only else parse(text or "", language)
                for row in node_rows(uri, tree):
                    if kinds is None or row[4] in kinds:
                        for out, k in zip(held, at):
                            out.append(row[k])
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, _NODE_KINDS[k]) for c, k in zip(held, at)], names=wanted)

    return spread(sources.select("uri", "text")).mapInArrow(run, schema)
