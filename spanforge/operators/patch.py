"""Patches (search/replace, create, delete), text edits, and verified commits.

    diff --git a/x b/x
    <<<<<<< SEARCH
    old
    =======
    new
    >>>>>>> REPLACE
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from ..sources.trees import PROVIDERS, parse, position

# The marker lines of a patch.
SEARCH, SEPARATOR, REPLACE = "<<<<<<< SEARCH", "=======", ">>>>>>> REPLACE"
_HEADER = re.compile(r'^diff --git (?:"a/((?:[^"\\]|\\.)*)"|a/(\S+)) (?:"b/((?:[^"\\]|\\.)*)"|b/(\S+))\s*$')
CONTEXT_BYTES = 50


class PatchError(ValueError):
    pass


@dataclass(frozen=True)
class PatchOperation:
    op: str  # modify, create, delete
    path: str
    blocks: tuple[tuple[str, str], ...] = field(default=())
    content: str | None = None


def safe_path(path: str) -> str:
    """Rejects empty, absolute and parent paths."""
    parts = path.replace("\\", "/").split("/")
    if not path or path.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", path) or ".." in parts:
        raise PatchError(f"unsafe path: {path!r}")
    return "/".join(p for p in parts if p not in ("", "."))


def parse_patch(text: str) -> list[PatchOperation]:
    if "\0" in text:
        raise PatchError("binary patch")
    chunks: list[tuple[str, list[str]]] = []
    inside = False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        m = None if inside else _HEADER.match(bare)
        if m:
            path = m[3] if m[3] is not None else m[4]
            chunks.append((re.sub(r"\\(.)", r"\1", path) if m[3] is not None else path, []))
            continue
        if bare == SEARCH:
            inside = True
        elif bare == REPLACE:
            inside = False
        if chunks:
            chunks[-1][1].append(line)
        elif bare.strip():
            raise PatchError("a patch starts with `diff --git`")
    if not chunks:
        raise PatchError("empty patch")
    return [_operation(safe_path(path), lines) for path, lines in chunks]


def _operation(path: str, lines: list[str]) -> PatchOperation:
    bare = [x.rstrip("\r\n") for x in lines]
    head = bare[: next((k for k, x in enumerate(bare) if x in (SEARCH,) or x.startswith("@@")), len(bare))]
    if any(x.startswith("deleted file mode") for x in head):
        return PatchOperation("delete", path)
    if any(x.startswith("new file mode") for x in head):
        hunk = next((k for k, x in enumerate(bare) if x.startswith("@@")), None)
        if hunk is None:
            raise PatchError(f"{path}: a new file needs a hunk")
        return PatchOperation("create", path, content="".join(x[1:] for x in lines[hunk + 1 :] if x.startswith("+")))
    blocks: list[tuple[str, str]] = []
    state, search, replace = "", [], []
    for line, x in zip(lines, bare):
        if x == SEARCH and state == "":
            state, search, replace = "search", [], []
        elif x == SEPARATOR and state == "search":
            state = "replace"
        elif x == REPLACE and state:
            if state == "search":
                raise PatchError(f"{path}: unclosed SEARCH block")
            blocks.append(("".join(search), "".join(replace)))
            state = ""
        elif state:
            (search if state == "search" else replace).append(line)
    if state:
        raise PatchError(f"{path}: unclosed {state.upper()} block")
    if not blocks:
        raise PatchError(f"{path}: no SEARCH block")
    return PatchOperation("modify", path, tuple(blocks))


def dominant_ending(text: str) -> str:
    crlf = text.count("\r\n")
    return "\r\n" if crlf and crlf >= text.count("\n") - crlf else "\n"


def normalise_endings(text: str, ending: str) -> str:
    return text.replace("\r\n", "\n").replace("\n", ending)


def _fuzzy(text: str, needle: str, cursor: int) -> tuple[int, int] | None:
    """Span of needle from cursor on, line ends folded and spaces around the needle ignored. Offsets are characters throughout."""
    trimmed = needle.replace("\r\n", "\n").strip(" \t")
    if not trimmed:
        return None
    m = re.compile(re.escape(trimmed).replace("\\\n", "\n").replace("\n", "\r?\n")).search(text, cursor)
    return m and m.span()


def apply_blocks(text: str, blocks) -> str:
    """Each block is found from the cursor on, exactly or else loosely; the cursor moves past the replacement."""
    ending, cursor = dominant_ending(text), 0
    for k, (search, replace) in enumerate(blocks, 1):
        at = text.find(search, cursor)
        span = (at, at + len(search)) if at >= 0 else _fuzzy(text, search, cursor)
        if span is None:
            raise PatchError(f"search block {k} not found")
        new = normalise_endings(replace, ending)
        text = text[: span[0]] + new + text[span[1] :]
        cursor = span[0] + len(new)
    return text


_OPERATION = "path string, op string, content string, blocks array<struct<search:string,replace:string>>"


def operations(spark, patch: str) -> DataFrame:
    """The operations of a patch as rows (path, op, content, blocks); of several for a path the last one counts."""
    rows = {o.path: (o.path, o.op, o.content, list(o.blocks)) for o in parse_patch(patch)}
    return spark.createDataFrame(list(rows.values()), _OPERATION)


_APPLIED = "patch_id string, uri string, op string, text string, error string"


def _applied(batches):
    """Operations beside the file that they name."""
    for batch in batches:
        rows = []
        for key, path, op, content, blocks, found, old in zip(*(c.to_pylist() for c in batch.columns)):
            new, error = None, None
            if op == "create":
                new, error = (None, "file exists") if found else (content, None)
            elif not found:
                error = "file not found"
            elif op == "modify":
                try:
                    new = apply_blocks(old or "", [(x["search"], x["replace"]) for x in blocks])
                except PatchError as e:
                    error = str(e)
            rows.append((key, path, op, new, error))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["patch_id", "uri", "op", "text", "error"])


def apply_operations(sources: DataFrame, ops: DataFrame) -> DataFrame:
    """sources (uri, text) and one operation a path to uri, op, text (null: deleted), error.

    A file that a modify or delete names must exist, one that a create names must not.
    """
    files = sources.select("uri", "text")
    joined = ops.join(files, ops["path"] == files["uri"], "left").select(F.lit("").alias("patch_id"), "path", "op", "content", "blocks", F.col("uri").isNotNull().alias("found"), F.col("text").alias("old"))
    return joined.mapInArrow(_applied, _APPLIED).drop("patch_id")


def apply_patch(sources: DataFrame, patch: str) -> DataFrame:
    """A patch, which one request carries, applied to sources (uri, text): uri, op, text, error."""
    return apply_operations(sources, operations(sources.sparkSession, patch))


def patch_summary(result: DataFrame) -> DataFrame:
    """files_written (created or modified), files_deleted, failed."""
    ok = F.col("error").isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return result.agg(count(ok & (F.col("op") != "delete")).alias("files_written"), count(ok & (F.col("op") == "delete")).alias("files_deleted"), count(~ok).alias("failed"))


# -- text edits ------------------------------------------------------------------------


def apply_edits(text: str, edits: list[tuple[int, int, int, int, str]]) -> str:
    """(start line, start byte column, end line, end byte column, new text), 0-based, applied from the end."""
    raw = text.encode()
    starts = [0] + [m.end() for m in re.finditer(rb"\n", raw)]

    def offset(row: int, col: int) -> int:
        if not 0 <= row < len(starts):
            raise PatchError(f"line {row} out of range")
        end = starts[row + 1] - 1 if row + 1 < len(starts) else len(raw)
        if not 0 <= col <= end - starts[row]:
            raise PatchError(f"column {col} out of range in line {row}")
        return starts[row] + col

    for r0, c0, r1, c1, new in sorted(edits, key=lambda e: e[:2], reverse=True):
        raw = raw[: offset(r0, c0)] + new.encode() + raw[offset(r1, c1) :]
    return raw.decode(errors="replace")


def edit_sources(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """sources (uri, text), edits (uri, start_line, start_column, end_line, end_column, new_text) to uri, text, error."""
    e = F.struct("start_line", "start_column", "end_line", "end_column", "new_text")
    grouped = edits.groupBy("uri").agg(F.collect_list(e).alias("edits"))

    def run(batches):
        for batch in batches:
            rows = []
            for uri, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((uri, apply_edits(text or "", [tuple(x.values()) for x in found]), None))
                except PatchError as err:
                    rows.append((uri, None, str(err)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["uri", "text", "error"])

    return sources.join(grouped, "uri").select("uri", "text", "edits").mapInArrow(run, "uri string, text string, error string")


# -- locks and commits -----------------------------------------------------------------


def error_context(text: str) -> str:
    return text if len(text.encode()) <= CONTEXT_BYTES else text.encode()[: CONTEXT_BYTES - 3].decode(errors="ignore") + "..."


def syntactic_lock(sources: DataFrame) -> DataFrame:
    """sources (uri, language, text) to a row for each error or missing node: uri, line, column (1-based), kind, context; unknown languages pass."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for uri, language, text in zip(*(batch.column(c).to_pylist() for c in ("uri", "language", "text"))):
                if language not in PROVIDERS:
                    continue
                tree = parse(text or "", language)
                starts = tree.line_starts()
                for n in tree.root.walk():
                    if n.error or n.missing:
                        r, c = position(starts, n.start)
                        rows.append((uri, r + 1, c + 1, "missing" if n.missing else "error", error_context(tree.text(n))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["uri", "line", "column", "kind", "context"])

    return spread(sources.select("uri", "language", "text")).mapInArrow(run, "uri string, line long, column long, kind string, context string")


def verified_commit(changes: DataFrame, baseline: DataFrame | None, updated: DataFrame | None, path: str) -> str:
    """Writes changes (uri, language, text) if both locks pass: no_changes, syntactic_failure, semantic_failure or committed.

    The write is Spark's: staged, and visible only when the job commits. baseline and updated are diagnostics before and after.
    """
    from .deltas import new_diagnostics

    if changes.limit(1).count() == 0:
        return "no_changes"
    if syntactic_lock(changes).limit(1).count():
        return "syntactic_failure"
    if updated is not None and new_diagnostics(baseline, updated).limit(1).count():
        return "semantic_failure"
    changes.write.mode("errorifexists").parquet(path)
    return "committed"


# -- many patches ----------------------------------------------------------------------

_PARSED = "patch_id string, path string, op string, content string, blocks array<struct<search:string,replace:string>>, error string"


def parse_patches(patches: DataFrame) -> DataFrame:
    """patches (patch_id, text) to their operations, a row each; a patch that can't be read is one row with an error. Of several operations for a path the last one counts."""
    block = pa.struct([("search", pa.string()), ("replace", pa.string())])
    kinds = [pa.string()] * 4 + [pa.list_(block), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("patch_id").to_pylist(), batch.column("text").to_pylist()):
                try:
                    found = {o.path: o for o in parse_patch(text or "")}
                    rows += [(key, o.path, o.op, o.content, [{"search": s, "replace": r} for s, r in o.blocks], None) for o in found.values()]
                except PatchError as e:
                    rows.append((key, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["patch_id", "path", "op", "content", "blocks", "error"])

    return patches.select(F.col("patch_id").cast("string").alias("patch_id"), "text").mapInArrow(run, _PARSED)


def apply_patches(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Each patch (patch_id, text) applied by itself to sources (uri, text): patch_id, uri, op, text, error; an unreadable one gives its error without a uri."""
    parsed = parse_patches(patches)
    ops = parsed.filter("error is null")
    files = sources.select("uri", F.col("text").alias("old"))
    joined = ops.join(files, ops["path"] == files["uri"], "left").select("patch_id", "path", "op", "content", "blocks", F.col("uri").isNotNull().alias("found"), "old")
    done = joined.mapInArrow(_applied, _APPLIED)
    nothing = F.lit(None).cast("string")
    return done.unionByName(parsed.filter("error is not null").select("patch_id", nothing.alias("uri"), nothing.alias("op"), nothing.alias("text"), "error"))
