"""Quality rules: per-text counts, then cross-document line frequency.

One pass over the texts gives each document's counts and the hashes of its normalised
lines (words joined by one space, ASCII lower case). A line's frequency on a host (the
source column) is the number of distinct documents that hold it, copies included. A line is
removed if more than LINE_ALWAYS documents hold it, however large the host, or more than LINE_DOCS and more than
LINE_SHARE of the host's. A document that loses more than MAX_LOST of its line bytes is rejected.

Rules for odd input: null text has no words and fails the base rules; a null source is a
host of its own; rows with equal ids are documents of their own; of very long texts, LONG bytes or more, words are
held as 64-bit hashes; an empty table gives an empty result. Columns beside doc_id, text and source aren't read.

Scale: counts are combined before the shuffle, so a line in a third of all documents is a
row for each task; its join back to the lines is on a small table that Spark broadcasts if its
size allows and otherwise splits by skew.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .running import same

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: A line is removed if more than LINE_ALWAYS documents of its host hold it, or more than LINE_DOCS and more than LINE_SHARE of them.
LINE_ALWAYS = 50
LINE_DOCS = 5
LINE_SHARE = 0.05
MAX_LOST = 0.5
#: Texts from this length on are not split into a list of words at once.
LONG = 4 << 20

_SYMBOLS = b"#*$%&|<>"
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of words found twice or more, the first one included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    hit = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
    cover = np.zeros(len(words), bool)
    for k in range(window):
        cover[k : k + len(grams)] |= hit
    return int(cover.sum())


def repeated_hashes(words: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """The same of words given as 64-bit hashes."""
    if len(words) <= window:
        return 0
    n = len(words) - window + 1
    grams = words[:n].copy()
    for k in range(1, window):
        grams *= np.uint64(0x9FB21C651E98DF25)
        grams += words[k : n + k]
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    cover = np.zeros(len(words) + 1, np.int32)
    for a in range(0, n, 1 << 20):  # in blocks
        at = a + np.flatnonzero(spans.is_hot(grams[a : a + (1 << 20)], again))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def _long_counts(text: bytes) -> tuple:
    """base_counts of a very long text."""
    hashes, n, chars, symbols = [], 0, 0, 0
    for words in common.word_parts(text):
        bare = b"".join(words)
        n, chars, symbols = n + len(words), chars + len(bare.decode()), symbols + len(bare) - len(bare.translate(None, _SYMBOLS))
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    repeats = repeated_hashes(np.concatenate(hashes)) if hashes else 0
    worded = again = 0
    seen: set = set()
    for line in _lines(text):
        if not line.isspace():
            worded += 1
            again += (x := xxhash.xxh3_128_digest(line)) in seen
            seen.add(x)
    return n, chars, symbols, again, repeats, n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n


def _lines(text: bytes):
    """The lines of text that aren't empty."""
    at = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        if end > at:
            yield text[at:end]
        at = end + 1


def base_counts(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if len(text) >= LONG:
        return _long_counts(text)
    words = text.split()
    bare = b"".join(words)
    chars = len(bare.decode())
    symbols = len(bare) - len(bare.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    n = len(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n


def line_hash(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None without a word."""
    if len(line) >= LONG:
        h, gap = xxhash.xxh3_64(), b""
        for words in common.word_parts(line):
            h.update(gap + b" ".join(words).lower())
            gap = b" "
        return h.intdigest() - (1 << 63) if gap else None
    words = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Hash and length of each line that has a word."""
    found = [(h, len(x)) for x in _lines(text) if (h := line_hash(x)) is not None]
    return [h for h, _ in found], [n for _, n in found]


def _measure(batches):
    for batch in batches:
        rows = []
        for text in spans.texts(batch.column("text")):
            rows.append((*base_counts(text), *line_hashes(text)))
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "__rk", "source")] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "__rk", "source", *_NAMES, "lines", "sizes"])


def _verdicts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, __rk, source, text) to a row for each: counts, gone (hashes of removed lines, null: none), kept."""
    schema = f"doc_id long, __rk long, source string, {_COUNTS}, lines array<long>, sizes array<long>"
    rows = docs.select("doc_id", "__rk", "source", "text").mapInArrow(lambda it: common.tidy(_measure(it)), schema)
    rows = common.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "measured")
    hosts = rows.groupBy("source").agg(F.count("*").alias("docs")).withColumnRenamed("source", "__host")
    counts = rows.select("source", F.explode(F.array_distinct("lines")).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n")).filter(F.col("n") > LINE_DOCS)
    above = (F.col("n") > LINE_ALWAYS) | (F.col("n") > LINE_SHARE * F.col("docs"))
    often = counts.join(hosts, same(counts, hosts, [("source", "__host")])).filter(above).select(F.col("source").alias("__source"), F.col("line").alias("__line"))
    often = common.materialise(often, "frequent")
    lines = rows.select("row", "source", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("row", "source", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    hit = lines.join(often, same(lines, often, [("source", "__source"), ("line", "__line")])).groupBy("row").agg(F.sum("size").alias("lost"), F.collect_set("line").alias("gone")).withColumnRenamed("row", "__row")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = rows.withColumn("total", total).drop("lines", "sizes").join(hit, F.col("row") == F.col("__row"), "left")
    depleted = F.coalesce(F.col("lost") > MAX_LOST * F.col("total"), F.lit(False))
    return joined.select("doc_id", "__rk", "row", *_NAMES, "gone", (~F.col("base_failed") & ~depleted).alias("kept"))


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return _verdicts(docs.withColumn("__rk", F.lit(0).cast("long"))).select("doc_id", *_NAMES, "kept")


def cut_lines(text: str, gone) -> str:
    gone = set(gone)
    return b"\n".join(x for x in text.encode().split(b"\n") if line_hash(x) not in gone).decode()


@common.keeping_columns
def quality_filter(docs: DataFrame) -> DataFrame:
    """docs that pass, without their frequent lines (n_chars, where there is one, brought up to date)."""
    names = docs.columns
    keyed = common.with_row_key(docs)
    kept = _verdicts(keyed).filter("kept").select(F.col("doc_id").alias("__id"), F.col("__rk").alias("__key"), "gone").dropDuplicates(["__id", "__key"]).withColumnRenamed("gone", "__gone")
    joined = keyed.join(kept, same(keyed, kept, [("doc_id", "__id"), ("__rk", "__key")]))

    @F.pandas_udf("string")
    def cut(text, gone):
        return text.combine(gone, lambda t, g: t if t is None or g is None else cut_lines(t, g))

    touched = F.col("__gone").isNotNull()
    out = joined.withColumn("text", F.when(touched, cut(F.when(touched, F.col("text")), "__gone")).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)
