"""Queries over rule files written out of table rows: what each must compile to, or what is wrong with it and where.

Each file is one of CASES with its row's key in it. What must come is stated beside it, by hand; SQL only puts the key in and
counts bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as tx
from .operators import observe, patch
from .operators.slices import SliceRequest
from .plans.checks import check_rule_files
from .queries import _t, query
from .sources import snapshots
from .sources.storage import shared_dir

_HEAD = "rules:\n  - id: é@K\n    message: mé@K\n    languages: [python]\n    severity: ERROR\n"
_SCHEMA, _MODE, _YAML = "E_SCHEMA_INVALID", "E_UNSUPPORTED_MODE", "E_YAML_PARSE"
#: What the span of a problem covers: the rule, the end of the file, or this text at its last place.
_RULE = "*"
_END = "^"


def _good(text: str, kind: str, atoms: str, plans: int = 1, constraints: str = "", fix: str = "", more: str = "") -> tuple:
    return text, plans, kind, atoms, constraints, fix, more, "", ""


def _bad(text: str, code: str, span: str) -> tuple:
    return text, 0, "", "", "", "", "", code, span


def _with(body: str, head: str = _HEAD) -> str:
    return head + "".join(f"    {line}\n" for line in body.split("\n"))


#: (file, plans, kind of the root, atoms, constraints, fix, other values, code, span)
CASES = [
    # the legacy keys, and what they normalise to
    _good(_with("pattern: f@K($X)"), "Pattern", "f@K($X)"),
    _good(_with("pattern-regex: a@K+"), "Regex", "a@K+"),
    _good(_with("pattern-either: [{pattern: a@K}, {pattern-regex: b@K}]"), "Or", "a@K|b@K"),
    _good(_with("patterns: [{pattern: a@K}, {pattern-not: b@K}, {pattern-inside: c@K}, {pattern-not-inside: d@K}, {pattern-not-regex: e@K}]"), "And", "a@K|b@K|c@K|d@K|e@K"),
    _good(_with("patterns: [{pattern: a@K}, {semgrep-internal-pattern-anywhere: g@K}]"), "And", "a@K|g@K"),
    _good(_with("patterns: [{pattern: $X@K}, {metavariable-regex: {metavariable: $X, regex: z@K}}, {metavariable-pattern: {metavariable: $X, pattern: q@K}}]"), "And", "$X@K", constraints="$X =~ z@K|$X is q@K"),
    # a clause that is no formula is a constraint
    _good(_with("patterns: [{pattern: a@K}, {pattern-nott: b@K}]"), "And", "a@K", constraints='{"pattern-nott": "b@K"}'),
    # the match syntax: decorations, bare negation and containment, several languages, versions, unknown fields
    _good(_with("match: {any: [a@K, {regex: b@K}], as: $M@K, fix: put@K}"), "Or", "a@K|b@K", fix="put@K", more="$M@K"),
    _good(_with("match: {all: [a@K, {not: {inside: {pattern: b@K}}}], where: [{metavariable-regex: {metavariable: $A, regex: r@K}}]}"), "And", "a@K|b@K", constraints="$A =~ r@K"),
    _good(_with("match: {not: a@K}"), "Not", "a@K"),
    _good(_with("match: {inside: a@K}"), "Inside", "a@K"),
    _good(_with("match: {anywhere: {regex: a@K}}"), "Anywhere", "a@K"),
    _good(_with("pattern: a@K\nmin-version: 1.@K.0\nmax-version: 2.@K.0\nunknown-field: kept out", _HEAD.replace("[python]", "[python, rust, typescript]")), "Pattern", "a@K", plans=3, more="1.@K.0-2.@K.0"),
    # a dependency is a query that nothing matches
    _good(_with("r2c-internal-project-depends-on: {namespace: pypi, package: p@K}"), "TreeQuery", "(__NO_SUCH_NODE__) @_dependency_check"),
    _good(_with("mode: search\npattern: a@K"), "Pattern", "a@K"),
    # modes that don't run
    _bad(_with("mode: taint\npattern-sources: [a@K]\npattern-sinks: [b@K]"), _MODE, "taint"),
    _bad(_with("taint: {sources: [s@K]}\nmode: taint"), _MODE, "taint"),
    _bad(_with("join: {on: x@K}\nmode: join"), _MODE, "join"),
    _bad(_with("pattern: a@K\nextract: b@K\ndest-language: go\nmode: extract"), _MODE, "extract"),
    _bad(_with("mode: novel@K\npattern: a@K"), _MODE, "novel@K"),
    _bad(_with("pattern: a@K", _HEAD.replace("[python]", "[hcl]")), _MODE, ""),
    # headers, families, exclusivity, payloads
    _bad("rules:\n  - id: r@K\n    languages: [python]\n    severity: ERROR\n    pattern: a@K\n", _SCHEMA, _RULE),
    _bad("rules:\n  - message: é@K\n    pattern: a@K\n", _SCHEMA, _RULE),
    _bad(_with("pattern: a@K", _HEAD.replace("[python]", "[]")), _SCHEMA, _RULE),
    _bad(_with("pattern: a@K", _HEAD.replace("[python]", "[cobol@K]")), _SCHEMA, _RULE),
    _bad(_with("pattern: a@K", _HEAD.replace("ERROR", "BAD@K")), _SCHEMA, "BAD@K"),
    _bad(_with("pattern: a@K\njoin: {on: x@K}"), _SCHEMA, _RULE),
    _bad(_with("mode: taint\ntaint: {}\npattern-sinks: [b@K]"), _SCHEMA, _RULE),
    _bad(_with("mode: taint\nmatch: a@K\npattern-sources: [a]\npattern-sinks: [b]"), _SCHEMA, _RULE),
    _bad(_with("mode: extract\npattern: a@K\nextract: b@K"), _SCHEMA, _RULE),
    _bad(_with("mode: join\njoin: {}\npattern: a@K"), _SCHEMA, _RULE),
    _bad(_with("pattern: a@K\nmatch: b@K"), _SCHEMA, _RULE),
    _bad(_with("pattern: a@K\npattern-regex: b@K"), _SCHEMA, _RULE),
    _bad(_HEAD, _SCHEMA, _RULE),
    _bad(_with("match: {pattern: a@K, regex: b}"), _SCHEMA, "{pattern: a@K, regex: b}"),
    _bad(_with("match: {nope@K: a}"), _SCHEMA, "{nope@K: a}"),
    _bad(_with("patterns: [{pattern: a@K}, {metavariable-regex: {metavariable: $X}}]"), _SCHEMA, _RULE),
    _bad(_with("r2c-internal-project-depends-on: {namespace: pypi@K}"), _SCHEMA, _RULE),
    _bad(_with("pattern-regex: '(@K'"), _SCHEMA, _RULE),
    # formula checks; where both fail, negation in a disjunction comes first
    _bad(_with("pattern-either: [{pattern: a@K}, {pattern-not: b@K}]"), "E_INVALID_NOT_IN_OR", _RULE),
    _bad(_with("patterns: [{pattern-not: a@K}]"), "E_MISSING_POSITIVE_TERM_IN_AND", _RULE),
    _bad(_with("patterns: [{pattern-not: a@K}, {pattern-inside: {pattern-either: [{pattern: a}, {pattern-not: b}]}}]"), "E_INVALID_NOT_IN_OR", _RULE),
    # the file itself
    _bad("rules:\n  - id: r@K\n    id: s@K\n", _SCHEMA, "i"),
    _bad("# é@K\n- a\n", _SCHEMA, "- a\n"),
    _bad("rules: {a: b@K}\n", _SCHEMA, "{a: b@K}"),
    _bad("rules: [é@K", _YAML, _END),
]


def _quoted(text: str) -> str:
    return "replace('" + text.replace("'", "''").replace("\n", "¶") + "', '¶', chr(10))"


def _sql() -> str:
    rows = ",\n".join("(" + ", ".join([str(k), *(str(v) if isinstance(v, int) else _quoted(v) for v in case)]) + ")" for k, case in enumerate(CASES))
    return f"""WITH c(turn, text, plans, kind, atoms, constraints, fix, more, code, span) AS (VALUES {rows}),
p AS (SELECT p_partkey::VARCHAR AS k, c.* FROM part JOIN c ON turn = p_partkey % {len(CASES)}),
f AS (SELECT k, plans, code, span, replace(text, '@K', k) AS text, replace(span, '@K', k) AS covered, replace(kind, '@K', k) AS kind, replace(atoms, '@K', k) AS atoms, replace(constraints, '@K', k) AS constraints, replace(fix, '@K', k) AS fix, replace(more, '@K', k) AS more FROM p),
s AS (SELECT *, CASE WHEN span = '*' THEN strlen(split_part(text, '  - ', 1)) + 4 WHEN span = '^' THEN strlen(text) WHEN span = '' THEN NULL ELSE strlen(text) - strlen(split_part(text, covered, -1)) - strlen(covered) END AS a FROM f)
SELECT 'rules/' || k || '.yaml' AS uri, plans::INT AS n_plans, kind, atoms, constraints, fix, more, code, coalesce(a, -1)::BIGINT AS start_byte, CASE WHEN a IS NULL THEN -1 WHEN span = '*' THEN strlen(text) WHEN span = '^' THEN a ELSE a + strlen(covered) END::BIGINT AS end_byte FROM s"""


@query(_sql())
def rule_file_checks(spark, sf_dir):
    """A rule file for each part, compiled; its first plan, or its first problem and the bytes it is about."""
    files = F.element_at(F.array(*(F.lit(c[0]) for c in CASES)), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("rules/"), key, F.lit(".yaml")).alias("uri"), F.replace(files, F.lit("@K"), key).alias("text"))
    found = check_rule_files(rows)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    versions = F.concat("min_version", F.lit("-"), "max_version")
    return found.select("uri", "n_plans", F.coalesce("kind", F.lit("")).alias("kind"), text("atoms"), text("constraints"), F.coalesce("fix", F.lit("")).alias("fix"), F.coalesce("bound_as", versions, F.lit("")).alias("more"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("start_byte", F.lit(-1)).cast("long").alias("start_byte"), F.coalesce("end_byte", F.lit(-1)).cast("long").alias("end_byte"))


# -- patches as text -----------------------------------------------------------------------------------

_DIFF, _S, _M, _R = "diff --git a/f@K.py b/f@K.py\n", "<<<<<<< SEARCH\n", "=======\n", ">>>>>>> REPLACE\n"
#: (patch, then for each of its operations in order of path: path, operation, new text) or (patch, error). Files f@K.py hold "one @K\ntwo\nthree\n"; g@K.py doesn't exist.
PATCHES = [
    (_DIFF + _S + "one @K\n" + _M + "ONE @K\n" + _R, ("f@K.py", "modify", "ONE @K\ntwo\nthree\n", "")),
    (_DIFF + _S + "one @K\n" + _M + "two\n" + _R + _S + "two\n" + _M + "2\n2\n" + _R, ("f@K.py", "modify", "two\n2\n2\nthree\n", "")),
    ("diff --git a/new/g@K.py b/new/g@K.py\nnew file mode 100644\n--- /dev/null\n+++ b/new/g@K.py\n@@ -0,0 +1,2 @@\n+a @K\n+b\n" + _DIFF + "deleted file mode 100644\n", ("f@K.py", "delete", "", ""), ("new/g@K.py", "create", "a @K\nb\n", "")),
    (_DIFF + "new file mode 100644\n@@ -0,0 +1 @@\n+x\n", ("f@K.py", "create", "", "file exists")),
    ('diff --git "a/f@K.py" "b/f@K.py"\n' + _S + "  two  \n" + _M + _R, ("f@K.py", "modify", "", "search block 1 not found")),
    (_DIFF + _S + "  three\n" + _M + "3\n" + _R, ("f@K.py", "modify", "one @K\ntwo\n3\n", "")),
    ("diff --git a/g@K.py b/g@K.py\n" + _S + "one\n" + _M + "1\n" + _R, ("g@K.py", "modify", "", "file not found")),
    (_DIFF + _S + "one @K\n" + _M + "1\n", "f@K.py: unclosed REPLACE block"),
    (_DIFF + _S + "one @K\n", "f@K.py: unclosed SEARCH block"),
    (_DIFF + "index 1..2\n", "f@K.py: no SEARCH block"),
    (_DIFF + "new file mode 100644\n", "f@K.py: a new file needs a hunk"),
    ("just words @K\n", "a patch starts with `diff --git`"),
    ("", "empty patch"),
    ("diff --git a/x b/../f@K.py\n" + _S, "unsafe path: '../f@K.py'"),
    ("diff --git a/x b/C:/f@K.py\n" + _S, "unsafe path: 'C:/f@K.py'"),
    ("diff --git a/x b//etc/f@K.py\n" + _S, "unsafe path: '/etc/f@K.py'"),
]


def _patch_sql() -> str:
    rows = []
    for k, (_, *found) in enumerate(PATCHES):
        for one in found:
            path, op, text, error = ("", "", "", one) if isinstance(one, str) else one
            rows.append("(" + ", ".join([str(k), *map(_quoted, (path, op, text, error))]) + ")")
    return f"""WITH c(turn, path, op, text, error) AS (VALUES {", ".join(rows)})
SELECT p_partkey::VARCHAR AS patch_id, replace(path, '@K', p_partkey::VARCHAR) AS uri, op, replace(text, '@K', p_partkey::VARCHAR) AS text, replace(error, '@K', p_partkey::VARCHAR) AS error FROM part JOIN c ON turn = p_partkey % {len(PATCHES)}"""


@query(_patch_sql())
def patch_texts(spark, sf_dir):
    """Patch text of several files and blocks, read and applied; unreadable patches and unsafe paths are refused."""
    key = F.col("p_partkey").cast("string")
    text = F.element_at(F.array(*(F.lit(p[0]) for p in PATCHES)), (F.col("p_partkey") % len(PATCHES) + 1).cast("int"))
    p = _t(spark, sf_dir, "part")
    patches = p.select(key.alias("patch_id"), F.replace(text, F.lit("@K"), key).alias("text"))
    files = p.select(F.concat(F.lit("f"), key, F.lit(".py")).alias("uri"), F.concat(F.lit("one "), key, F.lit("\ntwo\nthree\n")).alias("text"))
    found = patch.apply_patches(files, patches)
    return found.select("patch_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("uri", "op", "text", "error")))


# -- slices and locks over written files -----------------------------------------------------------------


@query("""SELECT 'r' || p_partkey AS request_id, CASE WHEN p_partkey % 5 >= 3 THEN 'refusal' ELSE 'success' END AS status, CASE p_partkey % 5 WHEN 3 THEN 'unsupported_language' WHEN 4 THEN 'position_out_of_range' ELSE '' END AS reason,
  CASE WHEN p_partkey % 5 >= 3 THEN '' ELSE 'b' || p_partkey || ' a' || p_partkey END AS cards, CASE WHEN p_partkey % 5 >= 3 THEN 0 ELSE 1 END::INT AS spilled, p_partkey % 5 < 3 AS truncated FROM part""")
def graph_slices(spark, sf_dir):
    """The slice around a position in a file: the entry, its siblings in order as far as the budget goes, the rest spilled; refusals."""
    key, turn = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    p = _t(spark, sf_dir, "part")
    uri = F.concat(F.lit("src/f"), key, F.when(turn == 3, ".txt").otherwise(".py"))
    text = F.concat(*(F.concat(F.lit(f"def {c}"), key, F.lit("(x):\n    return x\n\n")) for c in "abc"))
    requests = p.select(F.concat(F.lit("r"), key).alias("request_id"), uri.alias("uri"), F.when(turn == 4, 99).otherwise(4).alias("line"), F.lit(5).alias("column"))
    found = observe.graph_slice(p.select(uri.alias("uri"), text.alias("text")), requests, SliceRequest("", 1, 1, max_cards=2))
    names = F.array_join(F.transform("cards", lambda c: c["name"]), " ")
    return found.select("request_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(names, F.lit("")).alias("cards"), F.coalesce(F.size("frontier"), F.lit(0)).alias("spilled"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query("""WITH p AS (SELECT p_partkey AS k, 'é = ' || p_partkey || ' +* 2 # ' || repeat(p_name || ' ', 9) AS line FROM part)
SELECT 'f' || k || '.py' AS uri, 1::BIGINT AS line, 1::BIGINT AS "column", 'error' AS kind, CASE k % 3 WHEN 0 THEN substr(line, 1, 46) || '...' ELSE 'x = (' || k || chr(10) END AS context FROM p WHERE k % 3 < 2""")
def lock_contexts(spark, sf_dir):
    """Where files don't parse, with the text there, cut at a number of bytes."""
    key, turn = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    long = F.concat(F.lit("é = "), key, F.lit(" +* 2 # "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(9)), F.lit("\n"))
    text = F.when(turn == 0, long).when(turn == 1, F.concat(F.lit("x = ("), key, F.lit("\n"))).otherwise(F.concat(F.lit("x = "), key, F.lit("\n")))
    files = _t(spark, sf_dir, "part").select(F.concat(F.lit("f"), key, F.lit(".py")).alias("uri"), F.lit("python").alias("language"), text.alias("text"))
    return patch.syntactic_lock(files)


@query("""SELECT p_partkey, '{"key":' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ',"name":"' || p_name || ' \\"q\\""' ELSE '' END || '}' AS body, true AS stamped FROM part""")
def json_and_time(spark, sf_dir):
    """2.13g, 2.13k: JSON objects without their nulls, and the time as requests stamp it."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(' "q"'))).alias("name"))
    return p.select("p_partkey", tx.json_compact("key", "name").alias("body"), tx.now_rfc3339().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


@query("""SELECT doc_id::VARCHAR AS uri, sha256(CASE doc_id % 4 WHEN 1 THEN 'changed ' || doc_id ELSE text END) AS content_hash FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'new/' || doc_id, sha256('new') FROM documents WHERE doc_id % 4 = 2""")
def snapshot_commits(spark, sf_dir):
    """All documents committed, then changed, deleted and added to in one commit; a writer that comes late is refused, a rollback is undone."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    docs, turn = _t(spark, sf_dir, "documents").filter("text is not null"), F.col("doc_id") % 4
    uri = F.col("doc_id").cast("string")
    snapshots.commit(docs.select(uri.alias("uri"), "text"), root, 0)
    changed = docs.filter(turn < 2).select(uri.alias("uri"), F.when(turn == 1, F.concat(F.lit("changed "), uri)).alias("text"))
    snapshots.commit(changed.unionByName(docs.filter(turn == 2).select(F.concat(F.lit("new/"), uri).alias("uri"), F.lit("new").alias("text"))), root, 1)
    try:
        snapshots.commit(docs.select(uri.alias("uri"), F.lit("late").alias("text")), root, 1)
    except snapshots.Conflict:
        snapshots.roll_back(spark, root, 1, 2)
        snapshots.roll_back(spark, root, 2, 3)
    return snapshots.read(spark, root).select("uri", tx.content_hash("text").alias("content_hash"))
