"""Formulas to DataFrames: every formula becomes a frame of matches (uri, span, captures).

Captures are arrays of structs sorted by name, so that they can be compared and deduplicated. A
conjunction keeps the spans of its first positive term; further positive terms are
existential in the same file, unified over shared metavariables; Inside is containment, Not is
overlap, Anywhere the same file; constraints filter last.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import diagnostics as dx
from ..plans import formula as fm
from ..plans.diagnostics import fail
from ..sources.files import spread
from ..sources.storage import materialise
from ..sources.trees import parse
from . import matcher, spans, tree_query

MATCH_COLUMNS = ["uri", "start_byte", "end_byte", "text", "captures"]
SPAN_SCHEMA = "uri string, start_byte long, end_byte long, text string, captures array<struct<name:string,kind:string,text:string,start_byte:long,end_byte:long>>"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(matcher.CAPTURE)]


def names_of(d: fm.Decorated, language: str) -> set[str]:
    """Metavariables that a formula's own matches bind."""
    own = {d.as_name} if d.as_name else set()
    if isinstance(d.node, fm.Pattern):
        return own | {f"${n}" for n in matcher.compile_pattern(d.node.text, language, True).names()} if language in _trees() else own
    if isinstance(d.node, fm.Regex):
        rx = re.compile(d.node.pattern)
        return own | {f"${n}" for n in rx.groupindex} | {f"${k}" for k in range(1, rx.groups + 1)}
    if isinstance(d.node, fm.TreeQuery):
        return own | {f"${n}" for n in tree_query.compile_query(d.node.query).names}
    if isinstance(d.node, fm.And):
        return own.union(*(names_of(b, language) for b in d.node.branches if fm.is_positive(b)))
    if isinstance(d.node, fm.Or):
        sets = [names_of(b, language) for b in d.node.branches if fm.is_positive(b)]
        return own | (set.intersection(*sets) if sets else set())
    return own


def _trees() -> tuple[str, ...]:
    return ("python", "rust", "typescript", "html", "prose")


def capture(name: str) -> Column:
    """The capture of a metavariable in a row, or null."""
    return F.get(F.filter("captures", lambda c: c["name"] == name), F.lit(0))


def _regex_rows(rx: re.Pattern, uri: str, text: str) -> Iterator[tuple]:
    label = {k: n for n, k in rx.groupindex.items()}
    plain = text.isascii()
    at, byte = 0, 0
    for m in rx.finditer(text):
        if plain:
            s, e = m.span()
            base = 0
        else:
            byte += len(text[at : m.start()].encode())
            at, s = m.start(), byte
            e = s + len(m[0].encode())
            base = s
        found = []
        for k in range(1, rx.groups + 1):
            if m[k] is None:
                continue
            gs = m.start(k) if plain else base + len(text[m.start() : m.start(k)].encode())
            c = {"kind": "regex", "text": m[k], "start_byte": gs, "end_byte": gs + len(m[k].encode())}
            found += [{"name": f"${n}"} | c for n in ((str(k), label[k]) if k in label else (str(k),))]
        yield uri, s, e, m[0], sorted(found, key=lambda c: c["name"])


def _query_rows(compiled, uri: str, tree) -> Iterator[tuple]:
    for node, found in tree_query.find(compiled, tree):
        captures = sorted(({"name": f"${n}", "kind": c.kind, "text": tree.text(c), "start_byte": c.start, "end_byte": c.end} for n, c in found), key=lambda c: c["name"])
        yield uri, node.start, node.end, tree.text(node), captures


def _pattern_rows(compiled, uri: str, tree, deep: int) -> Iterator[tuple]:
    for m in matcher.find_all(compiled, tree, deep):
        captures = [{"name": f"${k}", "kind": v.kind, "text": v.text, "start_byte": v.start, "end_byte": v.end} for k, v in sorted(m.captures.items())]
        yield uri, m.start, m.end, tree.source[m.start : m.end].decode(errors="replace"), captures


#: An atom: its class, its text.
Atom = tuple[type, str]


def atom_of(node: fm.Formula) -> Atom | None:
    if isinstance(node, fm.Pattern):
        return fm.Pattern, node.text
    if isinstance(node, fm.Regex):
        return fm.Regex, node.pattern
    return (fm.TreeQuery, node.query) if isinstance(node, fm.TreeQuery) else None


def scan(sources: DataFrame, atoms: list[Atom], language: str, deep: int = matcher.MAX_DEEP_NODES) -> DataFrame:
    """sources (uri, text) to the matches of all atoms, with column atom, their place in the list; a file is read and parsed once."""

    def compile_all() -> list:  # errors belong to the driver
        out = []
        for kind, text in atoms:
            if kind is fm.Pattern:
                out.append(matcher.compile_pattern(text, language, True))
            elif kind is fm.Regex:
                try:
                    out.append(re.compile(text))
                except re.error as e:
                    raise fail(dx.SCHEMA_INVALID, f"bad regex: {e}") from None
            else:
                out.append(tree_query.compile_query(text) if language in _trees() else None)
        return out

    # texts without the words of any atom are not read at all, those of an atom's not searched for it
    needs = [matcher.literals(c) if kind is fm.Pattern else [] for (kind, _), c in zip(atoms, compile_all())]
    trees_wanted = any(kind is not fm.Regex for kind, _ in atoms) and language in _trees()

    def run(batches):
        compiled = compile_all()
        for batch in batches:
            rows = []
            for uri, text in zip(batch.column("uri").to_pylist(), batch.column("text").to_pylist()):
                told = [all(w in (text or "") for w in words) for words in needs]
                wanted = trees_wanted and any(t and kind is not fm.Regex for t, (kind, _) in zip(told, atoms))
                tree = parse(text or "", language) if wanted else None
                for k, ((kind, _), c) in enumerate(zip(atoms, compiled)):
                    if not told[k]:
                        continue
                    if kind is fm.Regex:
                        found = _regex_rows(c, uri, text) if text is not None else ()
                    elif kind is fm.Pattern:
                        found = _pattern_rows(c, uri, tree, deep)
                    else:
                        found = _query_rows(c, uri, tree) if c is not None else ()
                    rows += [(*r, k) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*_KINDS, pa.int32()])], names=[*MATCH_COLUMNS, "atom"])

    read = matcher.holding(sources.select("uri", "text"), needs)
    return (spread(read) if trees_wanted else read).mapInArrow(run, f"{SPAN_SCHEMA}, atom int")


def regex_spans(sources: DataFrame, pattern: str) -> DataFrame:
    """Every match of a regex in whole texts, with byte spans; groups are captures."""
    return scan(sources, [(fm.Regex, pattern)], "regex").drop("atom")


def query_spans(sources: DataFrame, query: str, language: str) -> DataFrame:
    return scan(sources, [(fm.TreeQuery, query)], language).drop("atom")


class Scanned(NamedTuple):
    """Sources whose atoms have been looked for in one pass."""

    sources: DataFrame
    matches: DataFrame
    atoms: list[Atom]

    @property
    def sparkSession(self):  # noqa: N802
        return self.sources.sparkSession


#: Folders that the matches of a scan are dealt to, so that many rules don't make many small files.
FOLDERS = 32


def scanned(formulas: list[fm.Decorated], sources: DataFrame, language: str, deep: int = matcher.MAX_DEEP_NODES) -> Scanned | DataFrame:
    """The sources with the matches of all atoms of the formulas as a table, dealt to FOLDERS folders by atom; sources themselves if there is one atom only."""
    atoms = list(dict.fromkeys(a for f in formulas for d in f.walk() if (a := atom_of(d.node)) is not None))
    if len(atoms) < 2 or any(kind is fm.Pattern for kind, _ in atoms) and language not in _trees():
        return sources
    found = scan(sources, atoms, language, deep).withColumn("folder", F.pmod("atom", F.lit(FOLDERS)))
    return Scanned(sources, materialise(found, "atoms", "folder"), atoms)


def empty(sources: DataFrame) -> DataFrame:
    return sources.sparkSession.createDataFrame([], SPAN_SCHEMA)


def lower(d: fm.Decorated, sources: DataFrame | Scanned, language: str, deep: int = matcher.MAX_DEEP_NODES) -> DataFrame:
    """sources (uri, text) to the matches of a formula. deep: nodes that one search below a node may visit."""
    node = d.node
    if (atom := atom_of(node)) is not None:
        if atom[0] is fm.Pattern and language not in _trees():
            raise fail(dx.UNSUPPORTED_MODE, f"no tree provider for {language}", d.span)
        if isinstance(sources, Scanned):
            k = sources.atoms.index(atom)
            out = sources.matches.filter((F.col("folder") == k % FOLDERS) & (F.col("atom") == k)).select(*MATCH_COLUMNS)
        else:
            out = scan(sources, [atom], language, deep).drop("atom")
    elif isinstance(node, fm.And):
        out = _conjunction(node, sources, language, deep)
    elif isinstance(node, fm.Or):
        branches = [lower(b, sources, language, deep) for b in node.branches if fm.is_positive(b)]
        out = dedupe(_union(branches)) if branches else empty(sources)
    else:
        return empty(sources)  # a constraint without an anchor has no matches
    for c in d.where:
        out = constrain(out, c, sources, language)
    if d.as_name:
        name = d.as_name if d.as_name.startswith("$") else f"${d.as_name}"
        whole = F.struct(F.lit(name).alias("name"), F.lit("match").alias("kind"), F.col("text").alias("text"), F.col("start_byte").alias("start_byte"), F.col("end_byte").alias("end_byte"))
        out = out.withColumn("captures", F.array_sort(F.concat(F.filter("captures", lambda c: c["name"] != name), F.array(whole))))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dedupe(matches: DataFrame) -> DataFrame:
    """One row for each (uri, span, captures); captures are in name order already."""
    return matches.dropDuplicates(["uri", "start_byte", "end_byte", "captures"])


def _conjunction(node: fm.And, sources: DataFrame, language: str, deep: int) -> DataFrame:
    positive = [b for b in node.branches if fm.is_positive(b)]
    if not positive:
        return empty(sources)
    out, bound = lower(positive[0], sources, language, deep), names_of(positive[0], language)
    for other in positive[1:]:
        names = names_of(other, language)
        out = _also(out, lower(other, sources, language, deep), bound & names, names - bound)
        bound |= names
    for b in node.branches:
        if isinstance(b.node, (fm.Inside, fm.Anywhere)):
            out = _context(out, b.node, sources, language, deep, bound, False)
        elif isinstance(b.node, fm.Not):
            inner = b.node.inner
            if isinstance(inner.node, (fm.Inside, fm.Anywhere)):
                out = _context(out, inner.node, sources, language, deep, bound, True)
            elif isinstance(inner.node, fm.Not):
                out = spans.overlapping(out, lower(inner.node.inner, sources, language, deep))
            else:
                out = _without(out, lower(inner, sources, language, deep), bound & names_of(inner, language))
    return out


def _keys(df: DataFrame, names: set[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{k}": capture(n)["text"] for k, n in enumerate(sorted(names))})


def _on(n: int) -> Column:
    cond = F.col("uri") == F.col("__uri")
    for k in range(n):
        cond = cond & (F.col(f"__l{k}") == F.col(f"__r{k}"))
    return cond


def _right(df: DataFrame, names: set[str]) -> DataFrame:
    return _keys(df, names, "__r").withColumnsRenamed({"uri": "__uri", "start_byte": "__s", "end_byte": "__e", "text": "__text", "captures": "__captures"})


def _also(anchors: DataFrame, others: DataFrame, shared: set[str], new: set[str]) -> DataFrame:
    """Anchors with a compatible match of others in their file; new bindings come from the first such match."""
    left, right = _keys(anchors, shared, "__l"), _right(others, shared)
    if not new:
        return left.join(right, _on(len(shared)), "left_semi").select(*MATCH_COLUMNS)
    # one match for each file and shared binding, before the join: the join can't multiply
    keys = ["__uri", *(f"__r{k}" for k in range(len(shared)))]
    first = right.groupBy(*keys).agg(F.min_by("__captures", F.struct("__s", "__e")).alias("__captures"))
    joined = left.join(first, _on(len(shared)))
    more = F.filter("__captures", lambda c: c["name"].isin(sorted(new)))
    return joined.withColumn("captures", F.array_sort(F.concat("captures", more))).select(*MATCH_COLUMNS)


def _context(anchors: DataFrame, node: fm.Inside | fm.Anywhere, sources: DataFrame, language: str, deep: int, bound: set[str], negate: bool) -> DataFrame:
    others = lower(node.inner, sources, language, deep)
    shared = bound & names_of(node.inner, language)
    inside = isinstance(node, fm.Inside)
    if not shared:
        if inside:
            return spans.contained(anchors, others, negate)
        return anchors.join(others.select("uri").distinct(), "uri", "left_anti" if negate else "left_semi").select(*MATCH_COLUMNS)
    cond = _on(len(shared))
    if inside:
        cond = cond & (F.col("__s") <= F.col("start_byte")) & (F.col("end_byte") <= F.col("__e"))
    return _keys(anchors, shared, "__l").join(_right(others, shared), cond, "left_anti" if negate else "left_semi").select(*MATCH_COLUMNS)


def _without(anchors: DataFrame, others: DataFrame, shared: set[str]) -> DataFrame:
    if not shared:
        return spans.overlapping(anchors, others, negate=True)
    cond = _on(len(shared)) & (F.col("__s") < F.col("end_byte")) & (F.col("start_byte") < F.col("__e"))
    return _keys(anchors, shared, "__l").join(_right(others, shared), cond, "left_anti").select(*MATCH_COLUMNS)


# -- constraints -----------------------------------------------------------------------

_COMPARISON = re.compile(r"\s*(?:int\()?(\$[A-Z_][A-Z0-9_]*)\)?\s*(==|!=|<=|>=|<|>)\s*(-?\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\")\s*")


def constrain(matches: DataFrame, c: fm.Constraint, sources: DataFrame, language: str) -> DataFrame:
    if isinstance(c, fm.MetavariableRegex):
        name = c.metavariable if c.metavariable.startswith("$") else f"${c.metavariable}"
        return matches.filter(_matches(c.regex)(capture(name)["text"]))
    if isinstance(c, fm.MetavariablePattern):
        return _capture_pattern(matches, c, language)
    payload = json.loads(c.payload)
    key, value = next(iter(payload.items())) if isinstance(payload, dict) and payload else ("", None)
    if key in ("focus", "focus-metavariable"):
        return focus(matches, [value] if isinstance(value, str) else list(value))
    if key in ("comparison", "metavariable-comparison"):
        text = value if isinstance(value, str) else value.get("comparison", "")
        m = _COMPARISON.fullmatch(text)
        if not m:
            raise fail(dx.UNSUPPORTED_CONSTRAINT, f"comparison not understood: {text}")
        name, op, right = m.groups()
        left = capture(name)["text"]
        if right[0] in "'\"":
            a, b = left, F.lit(right[1:-1])
        else:
            a, b = left.try_cast("double"), F.lit(float(right))
        test = {"==": a == b, "!=": a != b, "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[op]
        return matches.filter(F.coalesce(test, F.lit(False)))
    raise fail(dx.UNSUPPORTED_CONSTRAINT, f"constraint `{key}` can't be executed")


def _matches(regex: str):
    """Whether a text begins with a match, in the dialect of regex atoms and of the checks before anything runs."""

    @F.pandas_udf("boolean")
    def holds(texts):
        rx = re.compile(regex)
        told = {t: rx.match(t) is not None for t in texts.dropna().unique()}
        return texts.map(lambda t: told.get(t, False))

    return holds


def _capture_pattern(matches: DataFrame, c: fm.MetavariablePattern, language: str) -> DataFrame:
    """A capture's own text is parsed and searched, equal texts of a batch once; rows without a match go."""
    matcher.compile_pattern(c.pattern, language, True)
    name = c.metavariable if c.metavariable.startswith("$") else f"${c.metavariable}"

    @F.pandas_udf("boolean")
    def holds(texts):
        compiled = matcher.compile_pattern(c.pattern, language, True)
        words = matcher.literals(compiled)
        told = {t: all(w in t for w in words) and matcher.find_first(compiled, parse(t, language)) is not None for t in texts.dropna().unique()}
        return texts.map(lambda t: told.get(t, False))

    return matches.filter(holds(capture(name)["text"]))


def focus(matches: DataFrame, names: list[str]) -> DataFrame:
    """Moves the span to the smallest of the named captures, the earlier of equals; a match that binds none keeps its span."""
    wanted = F.filter("captures", lambda c: c["name"].isin(names))
    best = F.array_min(F.transform(wanted, lambda c: F.struct((c["end_byte"] - c["start_byte"]).alias("len"), c["start_byte"].alias("s"), c["end_byte"].alias("e"))))
    return matches.withColumns({"start_byte": F.coalesce(best["s"], F.col("start_byte")), "end_byte": F.coalesce(best["e"], F.col("end_byte"))})


def cap(matches: DataFrame, most: int, partition: str = "rule_id") -> DataFrame:
    """The first matches of each rule, by uri and span.

    Matches are written once and counted. Only rules with more than most are sorted, over all tasks; whole partitions
    are kept up to the one in which a rule's last match lies, and in that one alone rows are ranked.
    """
    found = materialise(matches, "matches")
    over = found.groupBy(partition).count().filter(F.col("count") > most).select(F.col(partition).alias("__over"))
    over = materialise(over, "over")
    if not over.limit(1).count():
        return found
    order = ["uri", "start_byte", "end_byte"]
    many = found.join(over, F.col(partition) == F.col("__over"), "left_semi").repartitionByRange(partition, *order)
    many = materialise(many.withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = many.groupBy(F.col(partition).alias("__rule"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))  # about a row for each partition and rule
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__rule").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = many.join(sizes.withColumn("__before", before), (F.col(partition) == F.col("__rule")) & (F.col("__part") == F.col("__p"))).filter(F.col("__before") < most)
    whole = placed.filter(F.col("__before") + F.col("__n") <= most)
    last = placed.filter(F.col("__before") + F.col("__n") > most).withColumn("__rn", F.row_number().over(W.partitionBy(partition).orderBy(*order))).filter(F.col("__before") + F.col("__rn") <= most)
    few = found.join(over, F.col(partition) == F.col("__over"), "left_anti")
    return few.unionByName(whole.select(*found.columns)).unionByName(last.select(*found.columns))


def cap_capture_text(matches: DataFrame, most: int) -> DataFrame:
    """Null for capture texts of more bytes than most."""
    return matches.withColumn("captures", F.transform("captures", lambda c: c.withField("text", F.when(F.octet_length(c["text"]) <= most, c["text"]))))
