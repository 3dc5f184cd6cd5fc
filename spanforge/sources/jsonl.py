"""JSON lines: command requests in, stream and exit messages out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The longest request line, and the shape of a request.
MAX_LINE_BYTES = 1_048_576
REQUEST_SCHEMA = "command struct<domain:string,operation:string>, arguments array<string>, patch string"
#: Operations by domain, and those that run.
OPERATIONS = {
    "observe": ("get-definition", "find-references", "grep", "diagnostics", "call-hierarchy", "get-card", "graph-slice"),
    "act": ("rename-symbol", "apply-edits", "apply-patch", "apply-rewrite", "refactor"),
    "verify": ("diagnostics", "syntax"),
}


def parse_requests(lines: DataFrame) -> DataFrame:
    """lines (value) to command, arguments, patch, error."""
    r = F.from_json("value", REQUEST_SCHEMA)
    parsed = lines.select("*", r.alias("r"))
    domain, operation = F.lower(F.trim("r.command.domain")), F.lower(F.trim("r.command.operation"))
    table = F.create_map(*(x for d, ops in OPERATIONS.items() for x in (F.lit(d), F.array(*map(F.lit, ops)))))
    known = F.element_at(table, domain)
    error = (
        F.when(F.octet_length("value") > MAX_LINE_BYTES, "request too long")
        .when(F.col("r.command.domain").isNull() | F.col("r.command.operation").isNull(), "malformed request")
        .when(known.isNull(), F.concat(F.lit("unknown domain: "), domain))
        .when(~F.array_contains(known, operation), F.concat(F.lit("unknown operation: "), operation))
    )
    return parsed.select(domain.alias("domain"), operation.alias("operation"), "r.arguments", "r.patch", error.alias("error"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))


def stream_line(stream: str, data: str | Column) -> Column:
    return F.to_json(F.struct(F.lit("stream").alias("kind"), F.lit(stream).alias("stream"), (F.col(data) if isinstance(data, str) else data).alias("data")))


def exit_line(status: int | Column) -> Column:
    return F.to_json(F.struct(F.lit("exit").alias("kind"), (F.lit(status) if isinstance(status, int) else status).alias("status")))


def responses(results: DataFrame, data: str = "data", status: str = "status") -> DataFrame:
    """A stream line and then an exit line for each result row (value, ord)."""
    lines = F.array(F.struct(F.lit(0).alias("ord"), stream_line("stdout", data).alias("value")), F.struct(F.lit(1).alias("ord"), exit_line(F.col(status)).alias("value")))
    return results.select(*[c for c in results.columns if c not in (data, status)], F.explode(lines).alias("x")).select("*", "x.ord", "x.value").drop("x")


#: Fixed value: consecutive empty lines after which an output reader gives up.
MAX_EMPTY_LINES = 10


def read_output(lines, most: int = MAX_EMPTY_LINES) -> tuple[list[str], int | None]:
    """Stream data and exit status of response lines; stops at the exit, or after too many empty lines in a row."""
    data, empty = [], 0
    for line in lines:
        if not line.strip():
            empty += 1
            if empty >= most:
                raise ValueError(f"{most} empty lines in a row")
            continue
        empty = 0
        message = json.loads(line)
        if message["kind"] == "exit":
            return data, message["status"]
        data.append(message["data"])
    return data, None
