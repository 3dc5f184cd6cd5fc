"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record's fingerprint is a hash of its nested field paths (with the kind of each leaf). The
registry maps the fingerprints of known layouts to mappings, which say where turns and
their roles are; optional fields give a layout several fingerprints. A fingerprint that is new, as of a record with fields
beside those of its layout, is resolved once by a task: of the layouts whose fields it has, all of them texts, the one
with the most. Canonical turns are then
written by a template that marks turns, escapes control strings inside texts reversibly,
and records the spans of assistant text, the loss mask.

Rules for odd input: null text or role is empty; fields that no layout names are passed over; a record with the fields of
no layout, or that is no JSON, has null formatted output and layout "unknown"; an empty conversation formats to nothing; texts
may hold any control string, and turns that tie are ordered by role and text; an empty
table gives an empty result. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of others in use.
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

#: Declarative mappings. "turns": fixed fields in order, those with "?" optional;
#: "each": an array of turns with the fields of role and text; "roles": role names to canonical ones.
MAPPINGS = {
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "conversations": {"each": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    "instruction": {"turns": [("system", "system?"), ("user", "instruction"), ("user", "input?"), ("assistant", "output")], "merge": "\n\n"},
    "prompt": {"turns": [("system", "system?"), ("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"turns": [("system", "system?"), ("user", "prompt"), ("assistant", "response")]},
    "question": {"turns": [("user", "question"), ("assistant", "answer")]},
}


#: Fingerprints that a task remembers.
FINGERPRINTS = 10_000


def paths(value, at: str = "") -> set[str]:
    """Nested field paths with the kind of each leaf; array elements share a path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    kind = "text" if isinstance(value, str) else "null" if value is None else "other"
    return {f"{at}:{kind}"}


def fingerprint(found: set[str]) -> str:
    """Of field paths; a null leaf counts as text, as any field may be null."""
    return hashlib.sha256("\n".join(sorted({re.sub(":null$", ":text", p) for p in found})).encode()).hexdigest()[:16]


def registry(mappings: dict = MAPPINGS) -> dict[str, str]:
    """Fingerprint of each layout and each choice of its optional fields to its name."""
    out = {}
    for name, m in mappings.items():
        if "each" in m:
            out[fingerprint({f".{m['each']}[].{m['role']}:text", f".{m['each']}[].{m['text']}:text"})] = name
            out[fingerprint({f".{m['each']}[]"})] = name
            continue
        fixed = [f for _, f in m["turns"] if not f.endswith("?")]
        may = [f[:-1] for _, f in m["turns"] if f.endswith("?")]
        for n in range(len(may) + 1):
            for some in combinations(may, n):
                out[fingerprint({f".{f}:text" for f in (*fixed, *some)})] = name
    return out


def resolve(found: set[str], mappings: dict = MAPPINGS) -> str | None:
    """The layout whose fields are all there, as texts, whatever fields are there too; of several the one with the most, the first of equals."""
    found = {re.sub(":null$", ":text", p) for p in found}

    def texts(field: str) -> bool | None:
        own = {p for p in found if p.startswith(field) and p[len(field) : len(field) + 1] in (":", ".", "[", "{")}
        return own == {f"{field}:text"} if own else None

    best, most = None, 0
    for name, m in mappings.items():
        if "each" in m:
            each = f".{m['each']}[]"
            plain = not any(p == each or p.startswith(f"{each}:") or p.startswith(f"{each}[") for p in found)
            n = 2 if plain and texts(f"{each}.{m['role']}") and texts(f"{each}.{m['text']}") else 1 if each in found else 0
        else:
            fields = [(texts(f".{f.removesuffix('?')}"), f.endswith("?")) for _, f in m["turns"]]
            n = sum(bool(t) for t, _ in fields) if all(t or (t is None and optional) for t, optional in fields) else 0
        if n > most:
            best, most = name, n
    return best


def canonical(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) turns of a record."""
    roles = mapping.get("roles", {})
    if "each" in mapping:
        turns = [(x.get(mapping["role"]) or "", x.get(mapping["text"]) or "") for x in record[mapping["each"]]]
        return [(roles.get(r, r), t) for r, t in turns]
    out: list[tuple[str, str]] = []
    for role, field in mapping["turns"]:
        name = field.removesuffix("?")
        if name not in record:
            continue
        text = record[name] or ""
        if "merge" in mapping and out and out[-1][0] == role:
            out[-1] = (role, out[-1][1] + mapping["merge"] + text)
        else:
            out.append((role, text))
    return out


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of its assistant texts."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        parts += [head, body, f"{END}\n"]
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        k = at + len(TURN)
        start = k
        while formatted[k] != "\n":
            k += 2 if formatted[k] == "\\" else 1
        end = formatted.index(f"{END}\n", k + 1)
        turns.append((unescape(formatted[start:k]), unescape(formatted[k + 1 : end])))
        at = end + len(END) + 1
    return turns


FORMATTED_SCHEMA = "conv_id long, layout string, formatted string, loss array<struct<start:long,end:long>>"


def _format(batches, mappings: dict):
    known: dict[str, str | None] = dict(registry(mappings))
    loss_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        layouts, texts, losses = [], [], []
        for body in batch.column("record").to_pylist():
            try:
                record = json.loads(body) if body is not None else None
            except ValueError:
                record = None
            name = None
            if isinstance(record, dict):
                found = paths(record)
                if (mark := fingerprint(found)) not in known:
                    if len(known) > FINGERPRINTS:
                        known = registry(mappings)
                    known[mark] = resolve(found, mappings)
                name = known[mark]
            text, loss = render(canonical(record, mappings[name])) if name else (None, None)
            layouts.append(name or "unknown")
            texts.append(text)
            losses.append(loss and [{"start": a, "end": b} for a, b in loss])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(losses, loss_kind)], names=["conv_id", "layout", "formatted", "loss"])


def format_records(records: DataFrame, mappings: dict = MAPPINGS) -> DataFrame:
    """records (conv_id, record: JSON) to conv_id, layout, formatted, loss."""
    return records.select("conv_id", "record").mapInArrow(lambda it: _format(it, mappings), FORMATTED_SCHEMA)


def conversation_records(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) to one JSON record for each conversation, in the plainest layout that holds it.

    A conversation is one record, so its turns meet in one row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    shape = lambda *names: roles == F.array(*(F.lit(x) for x in names))
    text = lambda k: F.col("t")[k]["content"]
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = (
        F.when(shape("user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(shape("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return turns.select("conv_id", record.alias("record"))


def _read_back(batches):
    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
            if text is None:
                rows.append((conv, None, None, None, None, None))
                continue
            turns = parse(text)
            learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in loss or ())
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((conv, len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output."""
    formatted = format_records(conversation_records(rows))
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
