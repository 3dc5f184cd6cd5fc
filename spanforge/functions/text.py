"""Scalar functions: positions, line tables, names, hashes, languages, suggestions. All of them columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File extensions and language names.
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}
LOCK_EXTENSIONS = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript"}
ALIASES = {"rust": "rust", "rs": "rust", "python": "python", "py": "python", "typescript": "typescript", "ts": "typescript"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language_of(path: str | Column, table: dict[str, str] = EXTENSIONS) -> Column:
    """Language by extension, whatever its case; null for others."""
    return _lookup(F.nullif(F.lower(F.regexp_extract(_col(path), r"\.([^./\\]+)$", 1)), F.lit("")), table)


def language_name(name: str | Column) -> Column:
    """Language by name or alias, trimmed and folded."""
    return _lookup(F.lower(F.trim(_col(name))), ALIASES)


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line from 0, text, start_byte) of each \\n-separated line."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"))
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start_byte", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long"))


def line_start(text: Column, line: Column) -> Column:
    """Characters before a 0-based line, by whole text."""
    head = F.slice(F.split(text, "\n"), F.lit(1), line)
    return F.when(line == 0, F.lit(0)).otherwise(F.length(F.array_join(head, "\n")) + 1)


def byte_offset(text: str | Column, line: Column, column: Column) -> Column:
    """Byte of a 1-based line and 1-based character column; null if there is no such place."""
    text = _col(text)
    parts = F.split(text, "\n")
    row = F.get(parts, line - 1)
    head = line_start(text, line - 1)
    at = head + column - 1
    ok = (line >= 1) & (column >= 1) & (column <= F.length(F.regexp_replace(row, "\r$", "")) + 1)
    return F.when(ok, F.octet_length(F.substring(text, F.lit(1), at.cast("int"))))


def _position(position: str, text: str) -> tuple[Column, Column]:
    """Whether a "line:column" can be read, and its byte in the text."""
    parts = (F.regexp_extract_all(position, F.lit(r"^\s*([0-9]+):([0-9]+)\s*$"), F.lit(k)) for k in (1, 2))
    line, column = (F.get(p, F.lit(0)).try_cast("int") for p in parts)
    return F.coalesce((line >= 1) & (column >= 1), F.lit(False)), byte_offset(text, line, column)


def _position_error(read: Column, at: Column) -> Column:
    return F.when(~read, "parse").when(at.isNull(), "conversion").otherwise("")


def _error_counts(error: Column) -> list[Column]:
    return [F.coalesce(F.sum((error == kind).cast("long")), F.lit(0)).alias(f"{kind}_errors") for kind in ("parse", "conversion")]


def position_errors(requests: DataFrame) -> DataFrame:
    """requests (position: "line:column", text) to one row: how many positions can't be read, and how many have no place in the text."""
    return requests.agg(*_error_counts(_position_error(*_position("position", "text"))))


def answered_positions(requests: DataFrame, counters: Observation) -> DataFrame:
    """requests (position, text, ...) without text, with at, the byte of the position, and error (parse, conversion or empty).

    counters gets parse_errors and conversion_errors in the pass that computes the answers; read counters.get after it. A pass that is
    run again counts again, so what needs the answers twice should write them.
    """
    read, at = _position("position", "text")
    answers = requests.withColumns({"at": F.when(read, at), "error": _position_error(read, at)}).drop("text")
    return answers.observe(counters, *_error_counts(F.col("error")))


def utf16_length(text: str | Column) -> Column:
    """UTF-16 code units: characters, and one more for each beyond the basic plane."""
    text = _col(text)
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def content_hash(text: str | Column) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def symbol_id(*fields: str | Column) -> Column:
    """sym_ and 16 hex digits of the SHA-256 over length-prefixed fields; null counts as empty."""
    parts = []
    for f in fields:
        f = F.coalesce(_col(f).cast("string"), F.lit(""))
        parts += [F.octet_length(f).cast("string"), F.lit(":"), f]
    return F.concat(F.lit("sym_"), F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16))


def path_hint(path: str | Column) -> Column:
    return F.replace(_col(path), F.lit("\\"), F.lit("/"))


def token_estimate(json: str | Column) -> Column:
    return F.ceil(F.octet_length(_col(json)) / 4).cast("long")


def line_count(text: str | Column) -> Column:
    """Lines as a reader counts them, at least 1."""
    text = _col(text)
    n = F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1)
    return F.greatest(F.when(text == "", 1).otherwise(n), F.lit(1))


def dominant_ending(text: str | Column) -> Column:
    text = _col(text)
    crlf = F.regexp_count(text, F.lit("\r\n"))
    bare = F.regexp_count(text, F.lit("\n")) - crlf
    return F.when((crlf > 0) & (crlf >= bare), "crlf").otherwise("lf")


def normalise_endings(text: str | Column) -> Column:
    """To the dominant ending."""
    text = _col(text)
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(dominant_ending(text) == "crlf", F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)


def summary(doc: str | Column) -> Column:
    """The first line with anything on it, trimmed; null without one."""
    first = F.get(F.filter(F.transform(F.split(_col(doc), "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return first


def decorator_name(text: str | Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(F.trim(_col(text)), "^@", ""), "(", 1))


def import_name(text: str | Column) -> Column:
    """An import line without its keywords, visibility and semicolon."""
    t = F.regexp_replace(F.trim(_col(text)), r";\s*$", "")
    t = F.regexp_replace(t, r"^pub(\([^)]*\))?\s+", "")
    return F.trim(F.regexp_replace(t, r"^(use|import|from)\s+", ""))


def deletions(word: str, most: int) -> Column:
    """All strings that a word turns into when up to most characters are deleted, itself included."""
    shorter = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))

    def further(acc: Column, _: Column) -> Column:
        level = F.array_distinct(F.flatten(F.transform(acc["level"], shorter)))
        return F.struct(level.alias("level"), F.array_union(acc["every"], level).alias("every"))

    start = F.struct(F.array(word).alias("level"), F.array(word).alias("every"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, further)["every"] if most > 0 else F.array(word)


def suggestions(words: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """words (word), known (name) to word, suggestion: the nearest name within most edits, none if two are equally near.

    Two strings within most edits of each other have a string in common that each turns into by most deletions, so candidates
    come from an equi-join of deletions, and only these are measured. A word has about length ** most / most! of them: most is meant to be small.
    Repeated words count once; a name that is known twice is equally near to itself.
    """
    asked = words.select("word").distinct()
    names = known.groupBy("name").agg(F.count("*").alias("times"))
    left = asked.filter(F.col("word").isNotNull()).select("word", F.explode(deletions("word", most)).alias("key"))
    right = names.filter(F.col("name").isNotNull()).select("name", "times", F.explode(deletions("name", most)).alias("__key"))
    pairs = left.join(right, F.col("key") == F.col("__key")).select("word", "name", "times").distinct()
    measured = pairs.withColumn("d", F.levenshtein("word", "name", most)).filter("d >= 0")
    best = measured.groupBy("word", "d").agg(F.min("name").alias("name"), F.sum("times").alias("n")).groupBy(F.col("word").alias("__word")).agg(F.min(F.struct("d", "name", "n")).alias("best"))
    return asked.join(best, F.col("word") == F.col("__word"), "left").select("word", F.when(F.col("best.n") == 1, F.col("best.name")).alias("suggestion"))


def json_compact(*columns: str) -> Column:
    """A JSON object of columns without its nulls."""
    return F.to_json(F.struct(*columns))


def now_rfc3339() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def collapse_spaces(text: str) -> str:
    """White space outside string literals to single spaces."""
    out: list[str] = []
    for part in re.findall(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\s+|[^\s\"']+|[\"']", text):
        out.append(" " if part.isspace() else part)
    return "".join(out).strip()
