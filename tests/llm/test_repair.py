import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import repair


def plain_repair(rows):
    """rows (role, text) in order: (cost, audit, lines) by trying all edits, the cheapest first."""
    seen, faults = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    limit = 4 * len(rows) + 1

    def go(at, cost, audit, roles, lines, run):
        nonlocal best
        if cost > (best[0] if best else limit):
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if run < 3:
            for role in ("user", "assistant"):
                go(at, cost + 3, audit + "I", roles + role[0], lines + [f"{role}:"], run + 1)
        if at == len(rows):
            return
        role, text = rows[at]
        go(at + 1, cost + 4, audit + "D", roles, lines, 0)
        if faults[at] in ("blank", "duplicate"):
            return
        more = 3 if faults[at] else 0
        go(at + 1, cost + more, audit + "K", roles + (role[:1] or "?"), lines + [f"{role}:{text}"], 0)
        for new in ("user", "assistant"):
            go(at + 1, cost + 3 + more, audit + "R", roles + new[0], lines + [f"{new}:{text}"], 0)

    go(0, 0, "", "", [], 0)
    return best, faults


def cases(n, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        yield [(rng.choice(["user", "assistant", "assistant", "system", "tool", ""]), rng.choice(["Hi.", "Yes!", "cut off", " ", "", "What?", f"{rng.random()}."])) for _ in range(rng.randrange(7))]


def digest_of(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_is_cheapest_and_least(spark):
    all_cases = list(cases(150))
    rows = [(c, t, role, text, False) for c, case in enumerate(all_cases) for t, (role, text) in enumerate(case)]
    rows += [(c, None, None, None, True) for c in range(len(all_cases))]
    found = {r["conv_id"]: r for r in repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean")).collect()}
    assert len(found) == len(all_cases)
    for c, case in enumerate(all_cases):
        (cost, audit, lines), faults = plain_repair(case)
        r = found[c]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, digest_of(lines)), (case, r)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [role[:1] for role, _ in case]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert r["gaps"] == 0


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_pieces_join_to_the_whole(monkeypatch, piece):
    """A conversation cut anywhere, first pieces of unknown state included, repairs as one whole."""
    rng = random.Random(piece)
    names = ["conv_id", "part", "turn", "role", "text", "fault", "dropped", "again"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]
    rows = []
    for t in range(300):
        text = rng.choice(["Hi.", "cut", f"{t}."])
        rows.append((1, 0, t // 2 * 3, rng.choice(["user", "assistant", "assistant", "system"]), text, repair.NO_FAULT if text.endswith(".") else repair.TRUNCATED_FAULT, False, rng.random() < 0.1))

    def run(parts):
        batches = []
        for k, part in enumerate(parts):
            batch = pa.RecordBatch.from_arrays([pa.array([k if n == "part" else r[j] for r in part], kinds[j]) for j, n in enumerate(names)], names=names)
            batches += list(repair._pieces([batch]))
        return [r for b in repair._joined(batches) for r in b.to_pylist()]

    whole = run([rows])
    monkeypatch.setattr(repair, "PIECE", piece)
    assert run([rows]) == whole
    assert run([rows[:7], rows[7:8], rows[8:200], rows[200:]]) == whole
    assert whole[0]["gaps"] == 149 * 3 + 1 - 150


def test_long_conversation_stays_short_of_memory():
    layer = repair.fold([("u" if k % 3 else "a", 0) for k in range(30_000)], repair.close(repair.opening(repair.START)))
    assert len(layer[repair.ASSISTANT][1]) >= 30_000


def test_odd_conversations(spark):
    rows = [(1, None, "user", "a."), (1, 2, "user", None), (1, 2, "user", None), (None, 0, None, "x"), (None, 1, "assistant", "y" * 100_000 + "!"), (2, 0, "system", "only.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"order": F.lit(1), "__c": F.lit(2), "again": F.lit(3), "digest": F.lit(4)})
    found = {r["conv_id"]: r for r in repair.repair_conversations(df).collect()}
    assert (found[1]["blank"], found[1]["duplicate"], found[1]["gaps"], found[1]["audit"]) == (2, 0, 0, "KDDI")
    assert found[None]["audit"] == "RK" and found[None]["truncated"] == 1 and found[None]["cost"] == 6
    assert (found[2]["audit"], found[2]["cost"]) == ("D", 4)
    assert repair.repair_conversations(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "Ok! So.") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    out = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    for c, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = [r for r in out if (r["conv_id"], r["turn"]) == (c, t)]
        assert len(mine) == (2 if kind == 3 else 1) and mine[0]["dropped"] == (kind == 0)
        if c is not None:
            assert mine[0]["text"] == {1: "", 2: "Ok So"}.get(kind, "Ok! So.") and mine[0]["role"] == ("user" if kind == 4 else "assistant")
