"""Patches, edits, deltas, graphs, slices, cards, resolution, sources, functions, streaming."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import cards, deltas, graph, observe, patch, resolution, slices, spans
from spanforge.sources import files, jsonl, lsp, trees
from spanforge.streaming import requests as streaming

MODIFY = "diff --git a/x b/x\n<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE\n"


def test_patch_parsing():
    text = MODIFY + 'diff --git "a/a b" "b/a b"\nnew file mode 100644\n@@ -0,0 +1 @@\n+hello\n context\n+two\r\ndiff --git a/d b/d\ndeleted file mode 100644\n'
    ops = patch.parse_patch(text)
    assert [(o.op, o.path) for o in ops] == [("modify", "x"), ("create", "a b"), ("delete", "d")]
    assert ops[0].blocks == (("old\n", "new\n"),) and ops[1].content == "hello\ntwo\r\n"
    inner = MODIFY.replace("old", "diff --git a/q b/q")
    assert len(patch.parse_patch(inner)) == 1


@pytest.mark.parametrize("bad", ["", "text", "diff --git a/x b/x\n", MODIFY.replace(">>>>>>> REPLACE\n", ""), MODIFY.replace("=======\nnew\n>>>>>>> REPLACE\n", ""), MODIFY.replace("b/x", "b/../x"), MODIFY.replace("b/x", "b//x").replace("a/x b//x", "a/x b//etc"), "\0", "diff --git a/x b/x\nnew file mode 100644\n"])
def test_bad_patches(bad):
    with pytest.raises(patch.PatchError):
        patch.parse_patch(bad)


def test_blocks_move_forward_and_match_loosely():
    assert patch.apply_blocks("a\na\nb\n", [("a\n", "1\n"), ("a\n", "2\n")]) == "1\n2\nb\n"
    assert patch.apply_blocks("é x\r\nfoo\r\n", [("foo\n", "bar\n")]) == "é x\r\nbar\r\n"
    assert patch.apply_blocks("  if é:\n", [("\t if é:\n", "  if b:\n")]) == "    if b:\n"
    with pytest.raises(patch.PatchError, match="block 2"):
        patch.apply_blocks("a\nb\n", [("b\n", "c\n"), ("a\n", "d\n")])


def test_apply_patch(spark):
    src = spark.createDataFrame([("x", "old\n"), ("d", "gone"), ("e", "here")], "uri string, text string")
    text = MODIFY + MODIFY.replace("b/x", "b/missing") + "diff --git a/d b/d\ndeleted file mode 1\ndiff --git a/e b/e\nnew file mode 1\n@@\n+n\ndiff --git a/n b/n\nnew file mode 1\n@@\n+n\n"
    out = patch.apply_patch(src, text)
    got = {r.uri: (r.op, r.text, r.error) for r in out.collect()}
    assert got == {"x": ("modify", "new\n", None), "missing": ("modify", None, "file not found"), "d": ("delete", None, None), "e": ("create", None, "file exists"), "n": ("create", "n\n", None)}
    assert tuple(patch.patch_summary(out).first()) == (2, 1, 2)


def test_edits(spark):
    assert patch.apply_edits("aé\nbc\n", [(0, 1, 0, 3, "X"), (1, 0, 1, 1, "Y")]) == "aX\nYc\n"
    src = spark.createDataFrame([("u", "abc"), ("v", "abc"), ("w", "abc")], "uri string, text string")
    edits = spark.createDataFrame([("u", 0, 0, 0, 1, "Z"), ("v", 3, 0, 3, 0, "Z"), ("u", 0, 2, 0, 3, "")], "uri string, start_line long, start_column long, end_line long, end_column long, new_text string")
    got = {r.uri: (r.text, bool(r.error)) for r in patch.edit_sources(src, edits).collect()}
    assert got == {"u": ("Zb", False), "v": (None, True)}


def test_locks_and_commit(spark, tmp_path):
    good = spark.createDataFrame([("a.py", "python", "x = 1\n"), ("t", None, "((")], "uri string, language string, text string")
    bad = spark.createDataFrame([("a.py", "python", "def (\n")], "uri string, language string, text string")
    assert patch.syntactic_lock(good).count() == 0 and patch.syntactic_lock(bad).first().kind == "error"
    d = "line int, character int, severity int, message string, code string"
    before, after = spark.createDataFrame([(1, 1, 1, "m", None)], d), spark.createDataFrame([(1, 1, 1, "m", None), (2, 1, None, "n", None), (3, 1, 3, "hint", None)], d)
    assert [r.line for r in deltas.new_diagnostics(before, after).collect()] == [2]
    commit = lambda c, *x: patch.verified_commit(c, *x, str(tmp_path / "out"))
    assert commit(good.limit(0), None, None) == "no_changes" and commit(bad, None, None) == "syntactic_failure"
    assert commit(good, before, after) == "semantic_failure" and not (tmp_path / "out").exists()
    assert commit(good, before, before) == "committed" and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert patch.error_context("x" * 60) == "x" * 47 + "..."


def test_history(spark):
    s = "symbol_id string, name string, container string, kind string, signature string"
    before = spark.createDataFrame([("1", "f", None, "Function", "f()"), ("2", "g", None, "Function", "g(a)"), ("3", "h", "C", "Method", "h(b)"), ("4", "gone", None, "Type", "t")], s)
    after = spark.createDataFrame([("1", "f", None, "Function", "f()"), ("9", "g", None, "Function", "g(a, b)"), ("8", "h2", "C", "Method", "h(b)")], s)
    got = {(r.before_id, r.after_id): (r.phase, r.probability) for r in deltas.match_symbols(before, after).collect()}
    assert {k: v[0] for k, v in got.items()} == {("1", "1"): 0, ("2", "9"): 1, ("3", "8"): 2}
    assert all(0.5 < p < 1 for _, p in got.values())


@pytest.fixture(scope="module")
def calls(spark):
    nodes = spark.createDataFrame([(x, x, None) for x in "abcde"] + [("m", "m", "C")], "id string, name string, container string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "b"), ("z", "a")], "caller string, callee string")
    return nodes, edges


def test_graphs(spark, calls):
    nodes, edges = calls
    root = spark.createDataFrame([("a",)], "id string")
    pairs = lambda df: sorted((r.caller, r.callee, r.depth) for r in df.collect())
    assert pairs(graph.callees_graph(edges, root, 4)) == [("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 3), ("d", "e", 4)]
    assert pairs(graph.callers_graph(edges, root, 1)) == [("c", "a", 1), ("z", "a", 1)]
    assert pairs(graph.callees_graph(edges, root, 0)) == []
    found, crossed = graph.build_graph(nodes, edges, root, 1)
    assert sorted(r.id for r in found.collect()) == ["a", "b", "c"] and crossed.count() == 3
    with pytest.raises(ValueError):
        graph.build_graph(nodes, edges, root.limit(0), 1)
    assert graph.find_node(nodes, "C.m").first().id == "m" == graph.find_node(nodes, "m").first().id
    assert sorted(r.id for r in graph.callers(edges, nodes, "a").collect()) == ["c"]
    assert {r.id: (r.fan_in, r.fan_out) for r in graph.fan(edges).collect()}["a"] == (2, 2)
    merged, all_edges = graph.merge_graphs([nodes, nodes.filter("id = 'a'").withColumn("name", F.lit("new"))], [edges, edges])
    assert merged.filter("id = 'a'").first().name == "new" and all_edges.count() == 14


def test_items_and_uris(spark):
    items = spark.createDataFrame([("f", 12, "file:///a%20b/x.py", 3, 4, None), ("g", 99, "other:x", 0, 0, "C")], "name string, kind int, uri string, line int, character int, detail string")
    got = {r.name: r for r in graph.items_to_nodes(items).collect()}
    assert (got["f"].id, got["f"].kind) == ("/a b/x.py:3:4:f", "function") and got["g"].kind == "unknown" and got["g"].path == "other:x"
    uris = spark.createDataFrame([("/a b/é",), ("rel",)], "p string").select(graph.path_to_uri("p").alias("u")).collect()
    assert [r.u for r in uris] == ["file:///a%20b/%C3%A9", None]


def test_slices(spark):
    r = slices.parse_request(["--uri", "file:///x.py", "--position", "3:4", "--edge-types", "import,call,call", "--max-cards", "2"])
    assert (r.line, r.edge_types, r.max_cards) == (3, ("call", "import"), 2)
    for bad in (["--nope", "1"], ["--uri", "x", "--position", "1:1"], ["--uri", "file:///x", "--position", "0:1"], ["--uri", "file:///x", "--position", "1:1", "--max-cards", "0"], ["--uri", "file:///x", "--position", "1:1", "--min-confidence", "2"], ["--uri"]):
        with pytest.raises(ValueError):
            slices.parse_request(bad)
    schema = "slice_id int, symbol_id string, is_entry boolean, container string, name string, kind string, start_line int, start_column int, end_line int, end_column int"
    rows = [(1, "e", True, None, "z", "function", 5, 0, 6, 0), (1, "a", False, None, "a", "function", 1, 0, 2, 0), (1, "a", False, None, "a", "function", 0, 0, 2, 0), (1, "b", False, "C", "b", "method", 3, 0, 4, 0), (1, "e", False, None, "z", "function", 5, 0, 6, 0)]
    out = slices.apply_budget(spark.createDataFrame(rows, schema), 2)
    assert [(x.symbol_id, x.kept) for x in out.orderBy("place").collect()] == [("e", True), ("a", True), ("b", False)]
    response = slices.slice_response(out).first()
    assert response.truncated and [c.symbol_id for c in response.cards] == ["e", "a"] and response.frontier[0].symbol_id == "b"
    edges = spark.createDataFrame([("call", 0.9, "out"), ("call", 0.1, "out"), ("config", 1.0, "in")], "type string, confidence double, direction string")
    assert slices.filter_edges(edges, r).count() == 1
    why = spark.createDataFrame([(True, True, None), (True, False, "rust"), (False, True, "rust"), (True, True, "rust")], "a boolean, b boolean, c string")
    assert [x[0] for x in why.select(slices.refusal(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["unsupported_language", "position_out_of_range", "no_symbol_at_position", None]


def test_priority_slice(spark):
    edges = spark.createDataFrame([("e", "a", 0.9), ("e", "b", 0.8), ("e", "low", 0.1), ("b", "c", 1.0), ("x", "e", 0.7), ("c", "d", 1.0)], "caller string, callee string, confidence double")
    costs = spark.createDataFrame([(k, 10) for k in "eabcdx"], "id string, tokens int")
    r = slices.SliceRequest("file:///u", 1, 1, depth=2, direction="out", max_cards=3, max_tokens=1000)
    got = {x.id: (x.depth, x.kept) for x in slices.priority_slice(edges, costs, "e", r).collect()}
    assert got == {"e": (0, True), "a": (1, True), "b": (1, True), "c": (2, False)}
    both = slices.SliceRequest("file:///u", 1, 1, depth=1, max_cards=9, max_tokens=25)
    got = {x.id: x.kept for x in slices.priority_slice(edges, costs, "e", both).collect()}
    assert got == {"e": True, "a": True, "b": False, "x": False}
    # what a hop doesn't go on from is spillover, all of it; edges of other types don't count
    wide = spark.createDataFrame([("e", f"n{k:02}", 0.9 - k / 100, "call") for k in range(9)] + [("e", "t", 0.95, "config"), ("n00", "m", 0.9, "call"), ("n08", "z", 0.9, "call")], "caller string, callee string, confidence double, type string")
    few = slices.SliceRequest("file:///u", 1, 1, depth=2, direction="out", max_cards=4, edge_types=("call",))
    got = {x.id: (x.depth, x.kept) for x in slices.priority_slice(wide, costs, "e", few).collect()}
    assert got == {"e": (0, True), "m": (2, False)} | {f"n{k:02}": (1, k < 3) for k in range(9)}
    two = slices.SliceRequest("file:///u", 1, 1, depth=2, direction="out", max_edges=2, edge_types=("call",))
    got = {x.id: (x.depth, x.kept) for x in slices.priority_slice(wide, costs, "e", two).collect()}
    assert got == {"e": (0, True), "m": (2, False)} | {f"n{k:02}": (1, k < 2) for k in range(9)}


PY = '''import os
from a import b

# about greet
@cached(1)
def greet(self, name: str, *args, n=2) -> str:
    """
    First line.
    """
    x, (y, z.q) = 1, 2
    if x:
        for k in y:
            pass
    def inner():
        while True: pass
    return x

class A(B):
    def m(self, k):
        return k
'''
RS = """use std::fmt;
pub struct P<T> { x: T }
impl<T> P<T> {
    pub fn new(x: T, y: &str) -> Self { let mut z = 1; if z > 0 { for i in 0..3 {} } P { x } }
    fn get(&self) -> &T { &self.x }
}
trait Shape { fn area(&self) -> f64; }
"""
TS = """import x from "y";
class C extends D {
  constructor(private a: number) { super(); }
  get(x: string): number { if (x) { return 1 } return 2; }
}
function f(a: number, b?: string): void { const q = 1; switch (a) { case 1: break } }
"""


def test_cards(spark):
    src = spark.createDataFrame([("d/g.py", "python", PY), ("p.rs", "rust", RS), ("c.ts", "typescript", TS), ("t.txt", None, "x"), ("e.py", "python", "def (")], "uri string, lang string, text string")
    found = cards.entities(src)
    rows = {(r.uri, r.name): r for r in found.collect()}
    g = rows["d/g.py", "greet"]
    assert (g.kind, g.returns, [b.kind for b in g.branches], g.decorators, g.comments) == ("Function", "str", ["if", "for"], ["@cached(1)"], ["about greet"])
    assert [p.name for p in g.params] == ["self", "name", "args", "n"] and [x.name for x in g.locals][:2] == ["x", "y"] and "inner" not in {n for _, n in rows}
    assert rows["d/g.py", "m"].container == "A" and [p.name for p in rows["d/g.py", "m"].params] == ["self", "k"]
    assert rows["d/g.py", "g"].imports == ["os", "a import b"]
    assert (rows["p.rs", "new"].container, rows["p.rs", "new"].returns, [b.kind for b in rows["p.rs", "new"].branches]) == ("P<T>", "Self", ["if", "for"])
    assert rows["p.rs", "get"].returns == "&T" and rows["p.rs", "Shape"].kind == "Interface" and ("p.rs", "area") not in rows and rows["p.rs", "P"].kind == "Type"
    assert rows["c.ts", "get"].container == "C" and [p.name for p in rows["c.ts", "constructor"].params] == ["a"] and rows["c.ts", "f"].returns == ": void"
    out = {r.symbol.name: r for r in cards.cards(found).collect()}
    assert out["greet"].doc.summary == "First line." and out["greet"].metrics.cyclomatic == 3 and out["greet"].etag == out["greet"].symbol.symbol_id
    low = cards.cards(found, "minimal").filter("symbol.name = 'greet'").first()
    assert low.signature is None and low.doc is None and low.metrics is None
    fan = spark.createDataFrame([(out["greet"].etag, 4, 5)], "id string, fan_in long, fan_out long")
    assert cards.cards(found, fan=fan).filter("symbol.name = 'greet'").first().metrics.fan_in == 4
    at = spark.createDataFrame([("d/g.py", PY.index("return k")), ("d/g.py", PY.index("os")), ("d/g.py", PY.index("class"))], "uri string, at long")
    assert sorted(r.name for r in cards.entity_at(at, found).collect()) == ["A", "g", "m"]


def test_symbol_ids_ignore_spacing(spark):
    ids = set()
    for text in ("def f(a: int,  b) -> int:\n    return a\n", "def f(a: int, b)  ->  int:\n\n    return a\n"):
        ids |= {r.etag for r in cards.cards(cards.entities(spark.createDataFrame([("u.py", "python", text)], "uri string, lang string, text string"))).collect()}
    assert len(ids) == 1 and next(iter(ids)).startswith("sym_")


def test_resolution(spark):
    m = spark.createDataFrame([("rope", "1", "actuator", ["Python "], ["rename"], "/r", 30), ("ra", "1", "actuator", ["rust"], ["rename"], "/a", 30), ("zed", "1", "actuator", ["python"], ["rename"], "/z", 30), ("doc", "1", "sensor", ["python"], ["hover"], "/d", 30)], "name string, version string, kind string, languages array<string>, capabilities array<string>, executable string, timeout_secs int")
    m = resolution.lower_languages(m)
    q = spark.createDataFrame([(1, "rename", "python", None), (2, "rename", "rust", "rope"), (3, "rename", "python", "doc"), (4, "rename", "python", "nobody"), (5, "rename", None, None), (6, "rename", "go", None), (7, "rename", "python", "zed"), (8, "format", "python", None)], "request_id int, capability string, language string, provider string")
    got = {r.request_id: r for r in resolution.resolve(m, q).collect()}
    assert {k: (r.outcome, r.selected_provider, r.refusal_reason) for k, r in got.items()} == {
        1: ("selected", "rope", None), 2: ("refused", None, "explicit_provider_mismatch"), 3: ("refused", None, "provider_lacks_capability"), 4: ("refused", None, "provider_not_found"),
        5: ("refused", None, "unsupported_language"), 6: ("refused", None, "no_matching_provider"), 7: ("selected", "zed", None), 8: ("refused", None, "no_matching_provider"),
    }
    assert [(c.provider, c.reason) for c in got[1].candidates] == [("ra", "unsupported_language"), ("rope", "matched_language_and_capability"), ("zed", "not_selected_by_policy")]
    assert [c.reason for c in got[7].candidates] == ["not_requested", "not_requested", "matched_language_and_capability"]
    prefer = spark.createDataFrame([("python", "zed")], "language string, provider string")
    assert resolution.resolve(m, q.filter("request_id = 1"), prefer).first().selected_provider == "zed"
    assert resolution.by(m, kind="sensor").count() == 1 and resolution.by(m, language=" Python", capability="rename").count() == 2
    errors = resolution.validate_manifests(m.union(m.filter("name = 'ra'")).union(spark.createDataFrame([("", "1", "x", ["a"], [], "/", 1), ("q", "1", "x", [], [], "/", 1), ("w", "1", "x", ["a"], [], "rel", 1)], m.schema)))
    assert errors.filter("error is null").count() == 3
    versions = spark.createDataFrame([("1.2.0", "1.9"), ("1.0", "2.0")], "a string, b string").select(resolution.compatible("a", "b")).collect()
    assert [r[0] for r in versions] == [True, False]


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "a.py").write_text("x\ny")
    (tmp_path / "b.RS").write_text("")
    got = {r.lang: r.text for r in files.read_sources(spark, f"file://{tmp_path}").collect()}
    assert got["python"] == "x\ny"
    for bad in ("/x", "http://x", "file:x"):
        with pytest.raises(ValueError):
            files.check_uri(bad)
    files.write_sources(files.read_sources(spark, f"file://{tmp_path}"), str(tmp_path / "out"))


def test_jsonl(spark, tmp_path):
    lines = [json.dumps({"command": {"domain": " Observe", "operation": "GREP"}, "arguments": ["a"]}), json.dumps({"command": {"domain": "x", "operation": "y"}}), json.dumps({"command": {"domain": "act", "operation": "fly"}}), "not json", "x" * 1_048_577]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = jsonl.read_requests(spark, str(tmp_path / "r.jsonl")).collect()
    assert (got[0].domain, got[0].operation, got[0].error) == ("observe", "grep", None)
    assert [r.error for r in got[1:]] == ["unknown domain: x", "unknown operation: fly", "malformed request", "request too long"]
    out = jsonl.responses(spark.createDataFrame([("d", 0)], "data string, status int")).orderBy("ord").collect()
    assert [json.loads(r.value) for r in out] == [{"kind": "stream", "stream": "stdout", "data": "d"}, {"kind": "exit", "status": 0}]


def test_output_reader():
    lines = ['{"kind": "stream", "stream": "stdout", "data": "a"}', "", '{"kind": "exit", "status": 3}', "never read"]
    assert jsonl.read_output(lines) == (["a"], 3) and jsonl.read_output([]) == ([], None)
    with pytest.raises(ValueError):
        jsonl.read_output([""] * 10)


def test_lsp_source(spark, tmp_path):
    span = {"start": {"line": 2, "character": 3}, "end": {"line": 2, "character": 9}}
    rows = [{"request_id": "1", "method": "definition", "result": {"uri": "file:///a", "range": span}}, {"request_id": "2", "method": "definition", "result": [{"targetUri": "file:///b", "targetSelectionRange": span}, {"uri": "file:///a", "range": span}, {"uri": "file:///b", "range": span}]}, {"request_id": "3", "method": "definition", "result": None}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = lsp.read_responses(spark, str(tmp_path / "r.jsonl"))
    got = lsp.definitions(df)
    assert sorted((r.request_id, r.uri, r.line, r.column) for r in got.collect()) == [("1", "file:///a", 3, 4), ("2", "file:///a", 3, 4), ("2", "file:///b", 3, 4), ("2", "file:///b", 3, 4)]
    groups = lsp.group_locations(got.filter("request_id = '2'")).orderBy("first").collect()
    assert [(g.uri, len(g["at"])) for g in groups] == [("file:///b", 2), ("file:///a", 1)]
    c = spark.createDataFrame([("s", ["tree_sitter_degraded_semantic"]), ("t", ["x"])], "symbol_id string, provenance array<string>")
    out = {r.symbol_id: r for r in lsp.enrich_with_hover(c, spark.createDataFrame([("s", "```py\nint\n```\nDeprecated")], "symbol_id string, text string")).collect()}
    assert (out["s"].lsp.type, out["s"].lsp.deprecated, out["s"].provenance, out["t"].lsp) == ("int", True, ["lsp_hover"], None)


def test_functions(spark):
    df = spark.createDataFrame([("aé\r\nb😀c\n", 2, 3)], "t string, l int, c int")
    r = df.select(tx.byte_offset("t", F.col("l"), F.col("c")).alias("b"), tx.byte_offset("t", F.lit(9), F.lit(1)).alias("none"), tx.utf16_length("t").alias("u"), tx.line_count("t").alias("n"), tx.dominant_ending("t").alias("e"), tx.normalise_endings("t").alias("norm")).first()
    assert (r.b, r.none, r.u, r.n, r.e, r.norm) == (len("aé\r\nb😀".encode()), None, 9, 2, "crlf", "aé\r\nb😀c\r\n")
    names = spark.createDataFrame([("@a.b(1)", "pub(crate) use x::y;", " Py ", "\n  x \ny", "C:\\a\\b.TSX")], "d string, i string, n string, s string, p string")
    r = names.select(tx.decorator_name("d"), tx.import_name("i"), tx.language_name("n"), tx.summary("s"), tx.path_hint("p"), tx.language_of("p")).first()
    assert tuple(r) == ("a.b", "x::y", "python", "x", "C:/a/b.TSX", "typescript")
    assert tx.collapse_spaces('a  =\n "x  y"  + \'q  \'') == 'a = "x  y" + \'q  \''
    words = spark.createDataFrame([("obsreve",), ("xx",), ("zzzzz",)], "word string")
    known = spark.createDataFrame([("observe",), ("xa",), ("xb",)], "name string")
    assert {r.word: r.suggestion for r in tx.suggestions(words, known).collect()} == {"obsreve": "observe", "xx": None, "zzzzz": None}
    assert spark.range(1).select(tx.now_rfc3339()).first()[0].endswith("Z")


def test_positions_are_counted_while_they_are_answered(spark):
    asked = spark.createDataFrame([("1:2", "aé"), ("1:9", "a"), ("x", "a"), ("0:1", "a"), (None, "a"), ("2:1", "a\nb"), ("1:1", None)], "position string, text string")
    counters, tracker = Observation(), spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    got = [(r.position, r.at, r.error) for r in tx.answered_positions(asked, counters).collect()]
    assert len(tracker.getJobIdsForGroup(None)) == before + 1
    assert got == [("1:2", 1, ""), ("1:9", None, "conversion"), ("x", None, "parse"), ("0:1", None, "parse"), (None, None, "parse"), ("2:1", 2, ""), ("1:1", None, "conversion")]
    assert counters.get == {"parse_errors": 3, "conversion_errors": 2} == tx.position_errors(asked).first().asDict()
    none = Observation()
    tx.answered_positions(asked.filter("false"), none).collect()
    assert none.get == {"parse_errors": 0, "conversion_errors": 0}


def test_consecutive_groups(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("a", 3, 3), ("a", 6, 6), ("a", 9, 9), ("b", 1, 1)], "k string, s int, e int")
    got = [(r.k, r.s, r.group) for r in deltas.consecutive_groups(df, ["k"], "s", "e").orderBy("k", "s").collect()]
    assert got == [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 6, 0), ("a", 9, 1), ("b", 1, 0)]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"command": {"domain": d, "operation": o}, "arguments": []}) for d, o in (("observe", "grep"), ("act", "refactor"), ("no", "no"))]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    handler = lambda df: df.select("domain", "operation", F.lit("done").alias("data"), F.lit(0).alias("status"))
    q = streaming.serve(streaming.request_stream(spark, str(tmp_path / "in")), {("observe", "grep"): handler}, str(tmp_path / "cp"), str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["kind"] for x in lines] == ["stream", "exit"] * 3  # the two lines of an answer follow each other
    got = sorted((a["data"], b["status"]) for a, b in zip(lines[::2], lines[1::2]))
    assert got == [("done", 0), ("not yet implemented", 1), ("unknown domain: no", 1)]
    events = spark.createDataFrame([("u", 1, "open", "a"), ("u", 2, "change", "b"), ("v", 1, "open", "c"), ("v", 2, "close", None)], "uri string, version int, kind string, text string")
    assert [(r.uri, r.text) for r in streaming.latest_documents(events).collect()] == [("u", "b")]
    rev = spark.createDataFrame([("u", "h"), ("u", "h"), ("u", "i")], "uri string, content_hash string")
    assert streaming.fresh_revisions(rev).count() == 2


def test_requests_end_to_end(spark):
    src = spark.createDataFrame([("file:///d/g.py", PY), ("file:///t.txt", "x")], "uri string, text string")
    lines = PY.split("\n")
    at = next(k for k, x in enumerate(lines, 1) if "return x" in x)
    asked = spark.createDataFrame([(1, "file:///d/g.py", at, 5), (2, "file:///d/g.py", 1, 1), (3, "file:///d/g.py", 3, 1), (4, "file:///d/g.py", 999, 1), (5, "file:///t.txt", 1, 1)], "request_id int, uri string, line int, column int")
    got = {r.request_id: r for r in observe.get_card(src, asked).collect()}
    assert {k: (r.status, r.reason, r.card and r.card.symbol.name) for k, r in got.items()} == {
        1: ("success", None, "greet"), 2: ("success", None, "g"), 3: ("refusal", "no_symbol_at_position", None), 4: ("refusal", "position_out_of_range", None), 5: ("refusal", "unsupported_language", None),
    }
    request = slices.SliceRequest("file:///d/g.py", at, 5, max_cards=2)
    out = {r.request_id: r for r in observe.graph_slice(src, asked.filter("request_id in (1, 4)"), request).collect()}
    assert [c.name for c in out[1].cards] == ["greet", "A"] and len(out[1].frontier) == 1 and out[1].truncated
    assert out[4].status == "refusal"


def test_equal_points_stay(spark):
    points = spark.createDataFrame([("f", 3), ("f", 3), ("f", 50)], "uri string, at int")
    intervals = spark.createDataFrame([("f", 0, 9, 0, "a"), ("f", 2, 5, 1, "b")], "uri string, start_byte int, end_byte int, ord int, name string")
    assert sorted((r.at, r.name) for r in spans.innermost(points, intervals).collect()) == [(3, "b"), (3, "b"), (50, None)]


def test_lines_without_their_words(spark):
    docs = spark.createDataFrame([("u", "one two. three\n\nfour"), ("v", ""), ("w", None)], "uri string, text string")
    kept = ("uri", "ord", "start_byte", "end_row", "end_col")
    want = trees.nodes(docs, "prose").filter("kind = 'line'").select(*kept)
    assert sorted(map(tuple, trees.nodes(docs, "prose", ("line",), kept).collect())) == sorted(map(tuple, want.collect()))


def test_matches_without_a_cap(spark):
    from spanforge.plans.engine import Engine, EngineConfig

    engine = Engine(EngineConfig(max_matches_per_rule=None))
    sources = spark.createDataFrame([("u", "a a a")], "uri string, text string")
    found = engine.execute(engine.compile_dsl("r", "prose", 'regex("a")'), sources)
    assert found.count() == 3 and "Window" not in found._jdf.queryExecution().toString()


def test_only_a_local_session_may_lack_a_shared_folder():
    from types import SimpleNamespace

    from spanforge.sources import storage

    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master))
    assert storage.shared_dir(session("local[4]", None)).startswith("file:")
    assert storage.shared_dir(session("spark://m:7077", "hdfs://x/")) == "hdfs://x"
    for master in ("spark://m:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError):
            storage.shared_dir(session(master, None))


def test_html_texts_keep_their_references():
    tree = trees.parse("<p>a &amp; b &#228;</p><p> &nbsp; </p><script>x &amp; y</script>", "html")
    assert [tree.text(n) for n in tree.root.walk() if n.kind == "text"] == ["a &amp; b &#228;", "&nbsp; ", "x &amp; y"]
