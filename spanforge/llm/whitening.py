"""Embedding whitening on exact sums.

Entries become integers x = floor(SCALE * c) + SHIFT. The distinct x vectors are the fit list of n; with
their sums S the rows (n * x - S) / n are centred without cancellation, as numerator
and sums are exact integers. RowMatrix.computeGramianMatrix over them, divided by n, is the covariance V; its
eigenvectors are found on the driver (a matrix of dimension * dimension numbers, whatever the rows), and
every row is projected on the first COMPONENTS of them in mapInPandas.

Odd input: vectors that are null or hold null or non-finite entries are dropped, empty ones have no component and so no row; zero and repeated
vectors and ids stay, a null id too. Vectors of different lengths are fitted apart, each with the n of its own length. A component without variance
(one distinct vector, or fewer of them than dimensions) has the whitened value null, and identity_error is over the others (null if there is none); explained is null if nothing
varies. Entries beyond 2**50 / SCALE are an error. deviation is exact; null where it exceeds a long. An empty table gives an empty result. Other columns aren't read.

Scale: the distinct x vectors are the one shuffle of vectors; copies meet in the partial aggregate. Sums are exact: x is below 2**51, so
n * x fits a decimal and, as is checked, a long where it is used as one. The fit list is written once, for the sums, the covariance and the check of identity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Share of the largest eigenvalue that counts as variance.
LEAST_SHARE = 1e-13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(rows: DataFrame) -> DataFrame:
    """Usable rows with x, an array of long."""
    e = F.col("embedding").cast("array<double>")
    usable = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(e, lambda c: F.when(F.abs(c) <= F.lit(2.0**50 / SCALE), F.floor(c * SCALE) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("an entry is too large to be whitened"))).cast("long"))
    return rows.filter(usable & (F.size("embedding") > 0)).select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), x.alias("x"))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array<double> column."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, exact sums of each dimension, and the largest absolute entry."""
    parts = fit.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.max(F.abs("c")).alias("most")).orderBy("k").collect()  # a row for each dimension
    return parts[0]["n"], [int(r["s"]) for r in parts], max(r["most"] for r in parts)


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they fit, else as Python's."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _whiten(frames, n, sums, project, explained, error, column):
    dims = len(sums)
    for frame in frames:
        if not len(frame):
            continue
        top = _numerators(np.stack(frame["x"].to_numpy()).astype(np.int64).reshape(-1, dims), n, sums)
        y = (top.astype(np.float64) / n) @ project
        if column:  # one array a row, for the check of identity
            yield pd.DataFrame({"y": list(y)})
            continue
        k = y.shape[1]
        exact = top.astype(object) if np.abs(top).max(initial=0) ** 2 >= 2**62 // max(dims, 1) else top.astype(np.int64)
        deviation = [int(d) if int(d) < 2**63 else None for d in (exact * exact).sum(1)]
        out = pd.DataFrame(
            {
                "vec_id": pd.array(np.repeat(frame["vec_id"].to_numpy(np.int64), k), "Int64"),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)),
                "n": np.int64(n),
                "deviation": pd.array([d for d in deviation for _ in range(k)], "Int64"),
                "whitened": pd.array(y.ravel(), "Float64"),
                "explained": pd.array(np.tile(explained, len(frame)), "Float64"),
                "identity_error": pd.array(np.full(len(frame) * k, error), "Float64"),
            }
        )
        out.loc[np.repeat(frame["no_id"].to_numpy(bool), k), "vec_id"] = pd.NA
        yield out


def _fitted(fit: DataFrame, dims: int, components: int):
    """n, S, the projection (centred x to whitened; nan where nothing varies), explained, and what the whitened fit list lacks of the identity."""
    n, sums, most = _sums(fit)
    scaled = F.array(*(F.lit(s).cast("decimal(38,0)") for s in sums))
    exact = F.zip_with("x", scaled, lambda c, s: ((c.cast("decimal(38,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("double") / F.lit(float(n))))
    if n * most < 2**62:  # fits a long, which is cheaper
        exact = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda c, s: (c * F.lit(n) - s).cast("double") / F.lit(float(n)))
    covariance = gramian(fit.select(exact.alias("centred")), "centred") / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][: min(components, dims)]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(covariance))
    varies = values > LEAST_SHARE * max(float(values[0]), 0.0)
    project = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    error = np.nan
    if varies.any():
        y = fit.select("x").mapInPandas(lambda it: _whiten(it, n, sums, project[:, varies], None, None, "y"), "y array<double>")
        error = float(np.abs(gramian(y, "y") / n - np.eye(int(varies.sum()))).max())
    return n, sums, project, explained, error


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = _integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    fit = common.materialise(rows.select("x").distinct(), "fit-list")
    lengths = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect())  # as many as there are lengths
    out = None
    for dims in lengths:
        mine = F.size("x") == dims
        model = _fitted(fit.filter(mine), dims, components)
        one = rows.filter(mine).mapInPandas(lambda it, m=model: _whiten(it, *m, None), SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else vectors.sparkSession.createDataFrame([], SCHEMA)
