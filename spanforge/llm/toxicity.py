"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, whatever they are, are the
unlabelled side. A linear model over hashed words and word beginnings is fitted by the
class-prior-corrected risk

    prior * mean_P loss(g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g)) + L1 * |w|

with the logistic loss: what the unlabelled side costs as negatives is corrected by what the
toxic share of it must cost, and the corrected part may not fall below zero; where it does, a step
is taken back up instead. The L1 term leaves weights to few features, so that a long text does not add up
many small ones: a document is the set of its features, wherever in the text they stand.

The prior is the toxic share of the training fold's labels (at least half a row), unless it is given.
The fit takes a bounded sample, chosen by hash of the id: POSITIVES confirmed toxic documents and UNLABELLED
others in the mean, dealt to at most MODELS classifiers, one a task, whose weights are averaged; each keeps
FEATURES features at most. Counts, prior and scores cover all rows and whole texts.

Odd input: null and empty texts score as texts without features; a null doc_id is in
no label's row and counts as the empty string for the fold; labels that are null are no labels; an id with several labels is
toxic if one of them says so; repeated rows are scored each; ids may repeat. Without a positive
in the training fold nothing can be learnt, and every score is 0. An empty table gives an empty result. Other columns aren't read.

Scale: one scan for the sample, one for the scores; no document is shuffled but those of the sample, as
lists of features. The models are what the driver sees: at most MODELS * FEATURES numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents in the fitted sample (means; the sample is drawn by hash of the id).
POSITIVES = 6000
UNLABELLED = 12000
#: Classifiers, and positives that one needs at least to be of use.
MODELS = 4
EACH = 750
FEATURES = 20_000
HASHES = 1 << 20
#: Word beginnings of these lengths are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6)
#: Documents of a classifier's sample that a feature must be in, and the standard errors by which its shares must differ.
LEAST = 3
APART = 4.5
STEPS = 400
RATE = 0.5
L1 = 2e-5
TOXIC = 0.7
FOLDS, HELD_OUT = 3, 1
_CACHE = 200_000
_EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, case and punctuation around it aside."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGES)
    grams = [f"{w[:k]}-" for k in BEGINNINGS if len(w) >= k]
    return tuple({zlib.crc32(g.encode()) % HASHES for g in (grams + [w] if w else grams)})


class _Features:
    """Word to features, for the words met last."""

    def __init__(self, of):
        self.of, self.known = of, {}

    def text(self, text: str | None) -> set:
        out: set = set()
        if not text:
            return out
        words: set = set()
        for part in common.word_parts(text.encode("utf-8", "surrogatepass")):
            words.update(part)
        known = self.known
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) >= _CACHE:
                    known.clear()
                f = self.of(w)
                if len(w) <= 64:
                    known[w] = f
            if f:
                out.update(f)
        return out


# -- the classifier --------------------------------------------------------------------------


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of the margin z."""
    return np.logaddexp(0, -z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives, corrected risk of negatives, which may be below zero) at these outputs."""
    return prior * float(_loss(positive).mean()), float(_loss(-unlabelled).mean() - prior * _loss(-positive).mean())


class _Rows:
    """Rows of 0/1 features, by their numbers."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.width, self.n = width, len(lists)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def outputs(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n) + b

    def pull(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, r[self.row], self.width)


def _selected(lists: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features that tell positives from the rest best, in order of number."""
    count = lambda which: np.bincount(np.concatenate([x for x, p in zip(lists, positive) if p == which] or [np.empty(0, np.int64)]), minlength=HASHES)
    p, u = count(True), count(False)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    share = (p + u) / (n_p + n_u)
    apart = np.abs(p / n_p - u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    apart[p + u < LEAST] = 0
    kept = np.argsort(-apart, kind="stable")[:FEATURES]
    return np.sort(kept[apart[kept] >= APART])


def _nothing() -> tuple[float, np.ndarray, np.ndarray]:
    return -np.inf, np.empty(0, np.int64), np.empty(0)


def fit(lists: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, features, weights) of one classifier, by proximal steps scaled for each weight."""
    if not positive.any() or positive.all():
        return _nothing()
    chosen = _selected(lists, positive)
    number = np.full(HASHES, -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    own = [(k := number[x])[k >= 0] for x in lists]
    P, U = (_Rows([x for x, p in zip(own, positive) if p == which], len(chosen)) for which in (True, False))
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    seen, seen_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(STEPS):
        zp, zu = P.outputs(w, b), U.outputs(w, b)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # derivatives by the outputs: positives as positives, and all as negatives, the toxic share taken out
        up, down_u, down_p = prior * (sp - 1) / P.n, su / U.n, -prior * sp / P.n
        if pu_risk(zp, zu, prior)[1] < 0:  # the corrected part must not be pushed further down
            gp, gu = -down_p, -down_u
        else:
            gp, gu = up + down_p, down_u
        g, gb = P.pull(gp) + U.pull(gu), gp.sum() + gu.sum()
        seen += g * g
        seen_b += gb * gb
        step = RATE / np.sqrt(seen)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 1e4) * L1, 0)
        b -= RATE * gb / np.sqrt(seen_b)
    held = np.flatnonzero(w)
    return b, chosen[held], w[held]


# -- Spark -----------------------------------------------------------------------------------


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(FOLDS))


def _drawn(share: float, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def _listed(batches):
    features = _Features(word_features)
    for batch in batches:
        lists = [np.fromiter(sorted(features.text(t)), np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "positive", "features"])


def _fit_group(table: pa.Table, prior: float) -> pa.Table:
    lists = [np.asarray(x, np.int64) for x in table.column("features").to_pylist()]
    b, features, weights = fit(lists, table.column("positive").to_numpy().astype(bool), prior)
    return pa.table({"intercept": pa.array([b]), "features": pa.array([features.tolist()], pa.list_(pa.int64())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def train(documents: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[float, dict[int, float]]:
    """(intercept, weight of each feature that has one) from the training fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return -np.inf, {}
    if prior is None:
        prior = min(0.9, max(n_toxic, 0.5) / max(n_known, 1))
    learnt = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
    n_docs = max(1, learnt.count())
    # at most some POSITIVES ids, so their broadcast is bounded
    confirmed = known.filter((F.col("toxic") == 1) & _drawn(POSITIVES / n_toxic, 1)).select(F.col("doc_id").alias("__id"))
    positive = learnt.join(F.broadcast(confirmed), F.col("doc_id") == F.col("__id"), "left_semi").withColumn("positive", F.lit(1))
    other = learnt.filter(_drawn(UNLABELLED / n_docs, 2)).withColumn("positive", F.lit(0))
    models = max(1, min(MODELS, n_toxic // EACH))
    listed = positive.unionByName(other).mapInArrow(_listed, "doc_id long, positive int, features array<int>")
    sample = listed.groupBy("doc_id", "positive").agg(F.min("features").alias("features")).withColumn("model", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(models)))
    fitted = sample.groupBy("model").applyInArrow(lambda t: _fit_group(t, prior), "intercept double, features array<bigint>, weights array<double>").collect()  # MODELS rows at most
    fitted = [r for r in fitted if np.isfinite(r["intercept"])]
    weights: dict[int, float] = {}
    for r in fitted:
        for f, w in zip(r["features"], r["weights"]):
            weights[f] = weights.get(f, 0.0) + w / len(fitted)
    return (sum(r["intercept"] for r in fitted) / len(fitted) if fitted else -np.inf), dict(sorted(weights.items()))


def _scores(batches, intercept: float, weights: dict):
    features = _Features(lambda word: tuple(f for f in word_features(word) if f in weights))
    for batch in batches:
        z = np.array([intercept + sum(weights[f] for f in sorted(features.text(t))) for t in batch.column("text").to_pylist()], np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(_sigmoid(z) if np.isfinite(intercept) else np.zeros(len(z)), pa.float64())], names=["doc_id", "held_out", "score"])


def toxicity_scores(documents: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents (doc_id, text); labels: doc_id, toxic."""
    intercept, weights = train(documents, labels, prior)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() == HELD_OUT).alias("held_out"))
    scored = rows.mapInArrow(lambda it: common.tidy(_scores(it, intercept, weights)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
