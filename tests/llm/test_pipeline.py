"""The pipeline against its stages run plainly in memory."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from spanforge.llm import packing

from . import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    names = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_quality_stage(stages):
    before, after = stages[:2]
    want = {r[0] for r in brute.quality([(r.doc_id, r.text, r.source) for r in before]) if r[-1]}
    assert {r.doc_id for r in after} == want


def test_near_dedup_stage(stages):
    before, after = stages[1:3]
    want = brute.near([(r.doc_id, r.doc_id, r.text) for r in before], 5)
    assert Counter(r.doc_id for r in after) == Counter({c for _, c in want.values()})


def test_substring_stage(stages):
    before, after = stages[2:4]
    want = {i: n - gone for i, n, gone, _ in brute.substring([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: len(brute.words(r.text)) for r in after} == want


def test_mixing_stage(stages):
    before, after = stages[3:5]
    texts = {r.doc_id: r for r in before}
    assert all(texts[r.doc_id] == r for r in after) and max(Counter(r.doc_id for r in after).values()) <= 2
    total = sum(len(brute.words(r.text)) for r in before)
    taken = sum(len(brute.words(r.text)) for r in after)
    assert 1.5 * total - max(len(brute.words(r.text)) for r in before) <= taken <= 1.5 * total


def test_packing_stage_and_run(spark, small, stages):
    before, after = stages[4:6]
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(brute.words(r.text))) for r in before)
    assert all(r.n_tokens <= r.padded_tokens for r in after)
    whole = corpus_pipeline.run(spark, small)
    assert Counter((r.doc_id, r.n_tokens, r.bucket) for r in whole.collect()) == Counter((r.doc_id, r.n_tokens, r.bucket) for r in after)
    assert re.match("[0-9]+$", str(packing.BUDGET))


def test_odd_inputs_end_to_end(spark, small, tmp_path):
    """Nulls in any column, empty and long texts, repeated ids and rows, columns with clashing names, an empty table."""
    text = " ".join(f"word{k}" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, __x int, n_words string, passes string"
    clashing = ["__rk", "__id", "__key", "__gone", "__t", "__n", "__RANK", "Row", "size", "__rest", "a.b", "kept", "__spans"]
    clash = [f"own {c}" for c in clashing]
    schema += "".join(f", `{c}` string" for c in clashing)
    rows = [(k, f"{text} own {k} " + " ".join(f"d{k}x{j}" for j in range(60)), "en", ["a", "b", None][k % 3], 9) for k in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (None, rows[0][1], None, "a", None), (None, None, None, None, None), rows[3], rows[3], (3, rows[5][1] + " tail", "en", "b", 1)]
    rows += [(30, " ".join(f"long{k}" for k in range(40_000)), "en", "a", 1), (31, "\n \t", "en", "a", 1)]
    for name, part in (("odd", rows), ("none", [])):
        spark.createDataFrame([(*r, "clash", 1, "clash", "clash", *clash) for r in part], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(f(spark, docs, small).collect(), schema)
        if k == 0:
            texts = [(r[0], r[1], r[3]) for r in rows]
            assert {r.doc_id for r in docs.collect()} == {w[0] for w in brute.quality(texts) if w[-1]}
        assert all(r.component_id == "clash" and r.passes == "clash" and list(r)[9:] == clash for r in docs.collect())
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in docs.collect()) and any(r.doc_id == 30 for r in out)
    assert all(r.n_tokens <= r.padded_tokens for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
