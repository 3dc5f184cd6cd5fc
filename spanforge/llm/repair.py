"""Conversation structure: faults are counted, and the cheapest edits that give a well-formed conversation are found.

Rows of a conversation are taken by turn (nulls first), then role and text. A row's first fault counts: blank
(no word), duplicate (role and text seen earlier in the conversation), truncated (the last character that isn't white is none of ``.!?``).
Edits: keep (K) costs 0, a new role (R) 3, delete (D) 4, insert an empty turn (I) 3; a truncated row that stays adds 3, and
blank and duplicate rows must go. The initials of the roles must come out as ``(s?(ua)+)?``.

A forward Viterbi pass runs over four states (nothing yet, after system, after user, after assistant); a state carries the least
(cost, audit), the initials of its edits, and a layer is closed with at most two inserts. Two audits of equal cost over the same
rows are never one the beginning of the other (it would cost more), so the least of a prefix stays the least of the whole.

Rows are range-sorted by conversation, turn, role and the beginning of the text, so a long conversation is spread over tasks.
A task folds each run of up to PIECE rows of one conversation to a matrix: the least (cost, audit) from each state to each. As
that product is associative, matrices are then joined in order, one conversation at a time, and the digest of the repaired text, which
is sequential by its nature, is fed from packed pieces. Duplicates are told by one aggregate over (conversation, role, text) beforehand.

Odd input: null roles and texts are one space; a role that doesn't begin with s, u or a, an empty one too, can't be kept; a null turn sorts first and isn't a turn number;
null conv_ids are one conversation; repeated rows are rows; rows of equal turn, role and text are told apart by nothing, and so only by number; very long texts pass through whole; an empty table gives an empty result.
Other columns aren't read.

Scale: one aggregate and one join by (conversation, role, digest of text), one range sort, one shuffle of pieces by conversation. No conversation is held whole, only its audit (a byte a row), of which what all
states share is set aside.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = 2048
PIECE_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that may come next in each state, and the state after it.
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ENDS = (START, ASSISTANT)
_FOLLOWS = {"su", "ua", "au"}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED_FAULT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}


# -- the grammar -------------------------------------------------------------------------------


def close(layer: list) -> list:
    """The layer after bounded inserts: a user where one may come, then an assistant. A third insert would come back to a state at a higher cost."""
    for state in (USER, ASSISTANT):
        for before in range(4):
            if layer[before] is not None and state in _NEXT[before].values() and state != SYSTEM:
                cost, audit = layer[before]
                offer = (cost + INSERT, audit + "I")
                if layer[state] is None or offer < layer[state]:
                    layer[state] = offer
    return layer


def step(layer: list, role: str, fault: int) -> list:
    """The layer after a row of this role initial and fault."""
    new = [None if at is None else (at[0] + DELETE, at[1] + "D") for at in layer]
    if fault in (BLANK, DUPLICATE):
        return close(new)
    more = TRUNCATED if fault == TRUNCATED_FAULT else 0
    for before, at in enumerate(layer):
        if at is None:
            continue
        for initial, state in _NEXT[before].items():
            if initial == role:
                offer = (at[0] + KEEP + more, at[1] + "K")
            elif initial in "ua":
                offer = (at[0] + REROLE + more, at[1] + "R")
            else:
                continue
            if new[state] is None or offer < new[state]:
                new[state] = offer
    return close(new)


def opening(state: int) -> list:
    """The layer before any row, for a piece that is entered in this state: inserts belong to the layer before it, but for the first."""
    return [(0, "") if k == state else None for k in range(4)]


def _settle(layer: list) -> tuple[str, list]:
    """What the audits of all states have in common, and the layer without it. Shorter tails make each step cheaper."""
    shared = os.path.commonprefix([at[1] for at in layer if at is not None])
    return shared, [at and (at[0], at[1][len(shared) :]) for at in layer]


def fold(rows: list[tuple[str, int]], layer: list) -> list:
    """The layer after rows (role initial, fault)."""
    done: list[str] = []
    for k, (role, fault) in enumerate(rows, 1):
        layer = step(layer, role, fault)
        if layer[ASSISTANT] is not None:  # from there all that these two can still become costs DELETE more at most
            bound = layer[ASSISTANT][0] + DELETE
            for state in (START, SYSTEM):
                if layer[state] is not None and layer[state][0] > bound:
                    layer[state] = None
        if k % 64 == 0:
            shared, layer = _settle(layer)
            done.append(shared)
    shared = "".join(done)
    return [at and (at[0], shared + at[1]) for at in layer]


def edited(state: int, audit: str, roles: list[str], texts: list[str]):
    """The lines of the rows that an audit leaves, entered in a state."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            state = _NEXT[state][roles[at][:1]]
            yield f"{roles[at]}:{texts[at]}"
            at += 1
            continue
        state = ASSISTANT if state == USER else USER
        yield f"{_NAMES[state]}:{texts[at] if edit == 'R' else ''}"
        at += edit == "R"


def _end_state(state: int, audit: str, roles: list[str]) -> int:
    at = 0
    for edit in audit:
        if edit == "K":
            state = _NEXT[state][roles[at][:1]]
        elif edit != "D":
            state = ASSISTANT if state == USER else USER
        at += edit != "I"
    return state


# -- pieces --------------------------------------------------------------------------------------

_PATH = pa.struct([("start", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECE = {
    "conv_id": pa.int64(), "part": pa.int32(), "place": pa.int64(), "n": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
    "first": pa.string(), "last": pa.string(), "turns": pa.int64(), "low": pa.int64(), "high": pa.int64(), "paths": pa.list_(_PATH), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
}
PIECES = "conv_id long, part int, place long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, paths array<struct<start:tinyint,end:tinyint,cost:long,audit:string>>, roles array<string>, texts array<string>"


def _piece(conv, part, place, rows: list, opens: bool) -> tuple:
    """rows: (turn, role, text, fault). opens: this is where the conversation begins, so only one state can be entered."""
    plain = [(r[1][:1], r[3]) for r in rows]
    paths = []
    for start in (START,) if opens else range(4):
        layer = fold(plain, close(opening(start)) if opens else opening(start))
        paths += [{"start": start, "end": end, "cost": at[0], "audit": at[1]} for end, at in enumerate(layer) if at is not None]
    count = lambda fault: sum(r[3] == fault for r in rows)
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in _FOLLOWS for (a, _), (b, _) in zip(plain, plain[1:]))
    first, last = (plain[0][0], plain[-1][0]) if rows else (None, None)
    distinct = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)
    return (conv, part, place, len(rows), count(BLANK), count(DUPLICATE), count(TRUNCATED_FAULT), illegal, first, last, distinct, turns[0] if turns else None, turns[-1] if turns else None, paths, [r[1] for r in rows], [r[2] for r in rows])


def _pieces(batches):
    """Sorted rows (conv_id, part, turn, role, text, fault, dropped, later) to pieces."""
    out: list = []
    held, now, opens, place, size, before = [], None, False, 0, 0, None
    any_yet = False

    def flush():
        nonlocal held, size, place, opens
        out.append(_piece(now, part, place, held, opens))
        held, size, opens = [], 0, False
        place += 1

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE.values())], names=list(_PIECE))

    part = None
    for batch in batches:
        for conv, part, turn, role, text, fault, dropped, again in zip(*(c.to_pylist() for c in batch.columns)):
            if not any_yet or conv != now:
                if any_yet:
                    flush()
                now, opens, place, before, any_yet = conv, any_yet, 0, None, True
            if dropped:
                continue
            if fault != BLANK and (again or (turn, role, text) == before):
                fault = DUPLICATE
            before = (turn, role, text)
            held.append((turn, role, text, fault))
            size += len(text)
            if len(held) >= PIECE or size >= PIECE_BYTES:
                flush()
        if len(out) >= 256 or sum(len(r[15]) for r in out) >= PIECE:
            yield batch_of(out)
            out = []
    if any_yet:
        flush()
    if out:
        yield batch_of(out)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Pieces of one conversation, joined in order."""

    def __init__(self, conv):
        self.conv, self.counts, self.last = conv, [0, 0, 0, 0], None
        self.turns, self.low, self.high = 0, None, None
        self.done: list[str] = []
        #: For each state: cost, audit beyond what is done, digest of the lines so far, whether there are any.
        self.layer = [(0, "", hashlib.sha256(), False), None, None, None]
        self.begun = False

    def add(self, row: dict) -> None:
        if not row["n"]:
            return
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += row[name]
        self.counts[3] += self.last is not None and self.last + row["first"] not in _FOLLOWS
        self.last = row["last"]
        if row["turns"]:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        if not self.begun:  # inserts before the first row; a piece that knew it came first has them already
            if {p["start"] for p in row["paths"]} != {START}:
                for state, at in enumerate(close(opening(START))):
                    if at is not None and state != START:
                        self.layer[state] = (at[0], at[1], *self._fed(hashlib.sha256(), False, edited(START, at[1], [], [])))
            self.begun = True
        best: list = [None] * 4
        for p in row["paths"]:
            at = self.layer[p["start"]]
            if at is not None:
                offer = (at[0] + p["cost"], at[1] + p["audit"], p["start"], p["audit"])
                if best[p["end"]] is None or offer[:2] < best[p["end"]][:2]:
                    best[p["end"]] = offer
        layer: list = [None] * 4
        for end, offer in enumerate(best):
            if offer is not None:
                cost, audit, start, own = offer
                digest, some = self.layer[start][2:]
                layer[end] = (cost, audit, *self._fed(digest.copy(), some, edited(start, own, row["roles"], row["texts"])))
        shared = os.path.commonprefix([at[1] for at in layer if at is not None])
        self.done.append(shared)
        self.layer = [at and (at[0], at[1][len(shared) :], *at[2:]) for at in layer]

    @staticmethod
    def _fed(digest, some: bool, lines):
        for line in lines:
            digest.update((("\n" if some else "") + line).encode())
            some = True
        return digest, some

    def result(self) -> tuple:
        cost, audit, digest, _ = min((self.layer[s] for s in _ENDS if self.layer[s] is not None), key=lambda at: at[:2])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts, cost, "".join(self.done) + audit, digest.hexdigest())


def _joined(batches):
    now, out = None, []
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if now is None or row["conv_id"] != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(row["conv_id"])
            now.add(row)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield batch_of(out)


# -- Spark ----------------------------------------------------------------------------------------

_WHITE = r"\x20\x09-\x0D"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; dropped: the row only names its conversation) to one row a conversation: its faults, and its cheapest repair."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    worded = F.rtrim(F.translate(F.col("text"), "\t\n\x0b\x0c\r", "     "))
    fault = F.when(worded == "", BLANK).when(~F.substring(worded, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(NO_FAULT)
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    base = base.withColumns({"fault": fault, "order": order, "digest": F.sha2("text", 256)})
    first = base.filter(~F.col("dropped")).groupBy("conv_id", "role", "digest").agg(F.min("order").alias("least"), F.max("order").alias("most"))
    first = first.filter(F.col("least") < F.col("most")).select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "least")
    told = base.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")) & (F.col("order") > F.col("least")), "left")
    told = told.select("conv_id", "turn", "role", "text", "fault", "dropped", F.col("__d").isNotNull().alias("again"), F.substring("text", 1, 16).alias("head"))
    dealt = told.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = dealt.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "fault", "dropped", "again").mapInArrow(lambda it: common.tidy(_pieces(it)), PIECES)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_joined, RESULT)


#: What becomes of a row by crc32(conv_id:turn) modulo DAMAGES.
DAMAGES = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, USERED = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn; dropped rows stay, marked, as they name their conversation."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn"))), F.lit(DAMAGES))
    rows = rows.select("conv_id", "turn", cell("role").alias("role"), cell("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNSTOPPED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == USERED, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == REPEATED, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == DROPPED).alias("dropped"), copies.alias("copy")).drop("copy")


def repair_digest(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged conversations."""
    return repair_conversations(damaged(rows))
