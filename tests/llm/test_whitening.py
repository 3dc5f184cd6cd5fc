import math

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import whitening


def plain(vectors):
    """x by row, fit list, sums."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    return x, fit, [sum(c) for c in zip(*fit)]


def check(found, vectors, components=16):
    x, fit, sums = plain(vectors)
    n, dims = len(fit), len(sums)
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dims)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == len(vectors) * k
    signs = {}
    for i, v in enumerate(x):
        for c in range(k):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
            y = np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ axes[:, c] / math.sqrt(values[c])
            if abs(y) > 1e-6:
                assert signs.setdefault(c, np.sign(y * r["whitened"])) == np.sign(y * r["whitened"])
            assert math.isclose(abs(y), abs(r["whitened"]), rel_tol=1e-6, abs_tol=1e-8)
            assert r["identity_error"] < 1e-9


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((120, 20)) * np.arange(1, 21)).astype(np.float32).tolist()
    vectors += vectors[:30] + [vectors[0]] * 50
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    check(whitening.whiten(df).collect(), vectors)
    small = [v[:3] for v in vectors]
    check(whitening.whiten(spark.createDataFrame(list(enumerate(small)), "vec_id long, embedding array<float>")).collect(), small)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (None, [0.0, 2.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, []), (8, [1.0]), (9, [1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "no_id": F.lit(2), "n": F.lit(3)})
    found = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] is not None, r["vec_id"], r["component"]) for r in found if r["vec_id"] is not None) == [(True, 1, 1)] * 2 + [(True, 1, 2)] * 2 + [(True, 6, 1), (True, 6, 2), (True, 8, 1), (True, 9, 1)]
    assert [r["component"] for r in found if r["vec_id"] is None] == [1, 2]
    assert {r["n"] for r in found if r["vec_id"] in (1, 6, None)} == {3} and {r["n"] for r in found if r["vec_id"] in (8, 9)} == {1}
    alone = [r for r in found if r["vec_id"] == 8][0]
    assert (alone["deviation"], alone["whitened"], alone["explained"], alone["identity_error"]) == (0, None, None, None)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_flat_dimension_and_large_entries(spark):
    rows = [(i, [float(i), 7.0, 2.0**30 + i * i]) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x, fit, sums = plain([v for _, v in rows])
    third = [r for r in found if r["component"] == 3]
    assert {r["whitened"] for r in third} == {None} and all(abs(r["explained"]) < 1e-12 for r in third)
    assert all(r["deviation"] == sum((40 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums)) and r["identity_error"] < 1e-6 for r in found)
