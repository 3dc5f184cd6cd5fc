import zlib

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import toxicity
from tests.conftest import DATA


def test_risk_is_corrected_and_never_pushed_below_zero():
    g = np.array([0.3, -1.0, 2.0])
    positive, negative = toxicity.pu_risk(g, g, 0.4)
    assert np.isclose(positive, 0.4 * np.log1p(np.exp(-g)).mean())
    assert np.isclose(negative, np.log1p(np.exp(g)).mean() - 0.4 * np.log1p(np.exp(g)).mean())
    rng = np.random.default_rng(0)
    lists = [rng.choice(2000, 30, replace=False) + 100 for _ in range(400)]
    positive = np.arange(400) < 60
    for k in range(400):
        if positive[k] or k % 10 == 0:
            lists[k] = np.append(lists[k], 5)
    b, features, weights = toxicity.fit(lists, positive, 0.1)
    assert 5 in features and b + weights[list(features).index(5)] > 1 > 0 > b


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity_scores(docs, labels)
    rows = found.join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.02


def test_labels_of_the_held_out_fold_are_not_read(spark, small):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda labels: {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert score(labels) == score(turned)


def test_odd_documents(spark):
    bad = [(i, f"you idiot number {i % 7} number") for i in range(60)]
    good = [(i, f"a kind word number {i % 7} number") for i in range(60, 400)]
    docs = spark.createDataFrame(bad + good + [(1000, None), (1001, ""), (None, "idiot"), (0, "an idiot again"), (1002, "fine " * 300_000 + "IDIOT!"), (1003, "x" * 2_000_000)], "doc_id long, text string")
    docs = docs.withColumns({"held_out": F.lit("a"), "positive": F.lit("b"), "features": F.lit("c"), "__id": F.lit(1)})
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 200)] + [(300, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == docs.count() and len(by[0]) == 2
    assert by[1000][0]["score"] == by[1001][0]["score"] < 0.5 and by[1000][0]["predicted"] == 0
    assert by[1002][0]["predicted"] == 1 and by[None][0]["predicted"] == 1 and by[1003][0]["predicted"] == 0
    assert sum(by[i][0]["predicted"] for i in range(60)) == 60 and sum(by[i][0]["predicted"] for i in range(60, 400)) == 0
    nothing = toxicity.toxicity_scores(docs, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in nothing} == {0.0} and len(nothing) == len(rows)
    assert toxicity.toxicity_scores(docs.limit(0), labels).collect() == []
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(rows)
