"""Shared helpers: spill folder, word rule, exact row keys, byte-range hashing, spans."""

from __future__ import annotations

import ctypes
import functools
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes outside \x20 and \x09-\x0D. bytes.split() without
#: arguments splits on exactly these six bytes (str.split() would split on more).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Used by a local session that names no folder; executors of a cluster share no such folder.
_LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL_CHECKPOINTS


#: Tables and archives that this process has written to the shared folder.
_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes what this process has written, but for the first since and the last keep tables; call it when no result that reads them is needed any more."""
    for path in _PATHS[since : len(_PATHS) - keep]:
        drop_path(spark, path)
        _PATHS.remove(path)


def written() -> int:
    """How many tables this process has written and not dropped."""
    return len(_PATHS)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column: one column-pruned scan, one number."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def unique_ids(df: DataFrame, column: str = "doc_id") -> bool:
    """Whether no id occurs twice (a partial aggregate and one shuffle of ids)."""
    return not df.groupBy(column).count().filter("count > 1").limit(1).count()


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds __rk, which with doc_id identifies a row's text exactly enough to join spans back.

    Where ids are unique it is the constant 0; otherwise a 64-bit hash of the text tells
    rows of one id apart (equal rows of one id share their result, which is the same).
    """
    return df.withColumn("__rk", F.lit(0).cast("long") if unique_ids(df) else F.xxhash64("text"))


def tidy(rows):
    """rows; then gives the memory that Arrow and the C library keep for reuse back to the system, as workers stay on idle."""
    yield from rows
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: nothing to do
        pass


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_parts(text: bytes, size: int = 1 << 20):
    """The words of text, in lists of about size bytes, so that a very long text is never a list of words at once."""
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        if words := text[at:end].split():
            yield words
        at = end


#: Columns of documents that operators work with; any other column of the caller is out of their sight.
_OWN = frozenset({"doc_id", "text", "lang", "source", "n_chars"})


def keeping_columns(operator):
    """An operator from documents to documents, for callers with further columns of any name: these travel in one struct and come back as they were."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        own = [c for c in docs.columns if c.lower() in _OWN]
        rest = {c: f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in _OWN}
        if not rest:
            return operator(docs, *args, **kw)
        packed = F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in rest.items()))
        out = operator(docs.select(*own, packed.alias("__rest")), *args, **kw)
        return out.select(*(F.col("__rest")[rest[c]].alias(c) if c in rest else F.col(c) for c in docs.columns))

    return run


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


# -- hashing of byte ranges ------------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


#: Tables of this process by size (plain: cached functions would travel to workers by name only).
_TABLES: dict = {}


def _byte_table() -> np.ndarray:
    if 0 not in _TABLES:
        _TABLES[0] = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES[0]


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, 2 ** bits of each; the largest table serves smaller ones."""
    if bits > _TABLES.get("bits", 0):
        out = []
        for p in (_P, _P_INV):
            a = np.full(1 << bits, p, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _TABLES["bits"], _TABLES["powers"] = bits, (out[0], out[1])
    return _TABLES["powers"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers) of the polynomial hash over buf."""
    n = len(buf)
    power, inverse = _powers(max(16, int(n).bit_length()))
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(_byte_table()[buf] * power[:n], out=s[1:])
    return s, inverse


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, the same wherever the range stands."""
    s, inverse = prefix_hash(buf)
    return mix((s[ends] - s[starts]) * inverse[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out


# -- spans -----------------------------------------------------------------------------


def merge_spans(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans packed as start << 32 | end (touching spans join)."""
    packed = np.sort(packed)
    s, e = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    first = np.ones(len(s), bool)
    first[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(first)
    return s[at], e[np.append(at[1:] - 1, len(e) - 1)]
