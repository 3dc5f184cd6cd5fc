"""Queries over more rows than the engine's default cap of matches a rule."""

import duckdb
import pytest

from spanforge import queries


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    spark.range(21_000).selectExpr("id AS p_partkey", "concat('part ', id % 7) AS p_name", "40 AS p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{folder}/part.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["constrained_match", "metavar_unification"])
def test_all_matches_are_returned(spark, many_parts, name):
    folder, con = many_parts
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    assert len(want) > 10_000
    assert sorted(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, folder).collect()) == want


def test_rule_files_are_composed_once_and_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    import yaml

    from spanforge.plans import checks
    from spanforge.rule_queries import CASES

    calls = []
    compose = yaml.composer.Composer.compose_document
    monkeypatch.setattr(yaml.composer.Composer, "compose_document", lambda self: calls.append(1) or compose(self))
    texts = [c[0].replace("@K", "7") for c in CASES]
    for k, text in enumerate(texts):
        checks.check_file(text, f"{k}.yaml")
    assert len(calls) <= len(texts)
    spark.createDataFrame([(f"{k}.yaml", t) for k, t in enumerate(texts * 3)], "uri string, text string").coalesce(1).write.parquet(f"{tmp_path}/rules")
    found = checks.check_rule_files(spark.read.parquet(f"{tmp_path}/rules"))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 3 * len(texts)


def test_similarity_join_writes_no_features(spark, tmp_path, monkeypatch):
    """Features are the bulk of the input: beside the pairs that are compared, only hashes of them go to disk. Copies find all their pairs."""
    import os

    from spanforge.operators import history
    from spanforge.sources import storage

    monkeypatch.setattr(storage, "_PATHS", [])
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file:")) for f in names)
    features = "transform(sequence(0, 199), k -> concat('b:', sha2(concat(id % 300, ' ', k), 256)))"
    spark.range(302).selectExpr("'x' AS kind", "id AS set_id", f"{features} AS features").write.parquet(f"{tmp_path}/sets")
    sets = spark.read.parquet(f"{tmp_path}/sets")
    found = history.similar_sets(sets.filter("set_id % 2 = 0 OR set_id = 1"), sets.filter("set_id % 2 = 1 OR set_id = 0"), 0.5)
    assert sorted((r.b_set, r.a_set, r.similarity) for r in found.collect()) == [(0, 0, 1.0), (1, 1, 1.0), (1, 301, 1.0), (300, 0, 1.0)]
    assert sum(map(size, storage._PATHS)) < size(f"{tmp_path}/sets") / 10


def test_a_chain_of_calls_is_built_once(monkeypatch):
    from spanforge.sources import trees

    made, node = [], trees.Node
    monkeypatch.setattr(trees, "Node", lambda *a, **b: made.append(1) or node(*a, **b))
    trees.parse("a" + "()" * 12 + "\n", "python")
    assert len(made) < 200


def test_similarity_join_sends_no_set_for_each_pair(spark, tmp_path):
    """Near copies of one set make many pairs; a set is shuffled for a tile of them."""
    import os

    from spanforge.operators import history

    kept = "filter(transform(sequence(0, 399), k -> IF(hash(id, k) % 10 = 0, concat('b:', sha2(concat(id, ' ', k), 256)), concat('b:', sha2(concat('all ', k), 256)))), x -> true)"
    spark.range(240).selectExpr("'x' AS kind", "id AS set_id", f"{kept} AS features").write.parquet(f"{tmp_path}/sets")
    sets = spark.read.parquet(f"{tmp_path}/sets")
    size = sum(os.path.getsize(f"{tmp_path}/sets/{f}") for f in os.listdir(f"{tmp_path}/sets"))
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = history.similar_sets(sets.filter("set_id % 2 = 0"), sets.filter("set_id % 2 = 1"), 0.5).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 120 * 120
    own = {r.set_id: set(r.features) for r in sets.collect()}
    assert all(r.similarity == len(own[r.b_set] & own[r.a_set]) / len(own[r.b_set] | own[r.a_set]) for r in found)
    assert shuffled() - before < 2 * size


def test_word_pairs_of_texts(spark):
    """By numpy as by strings: odd texts, words over the end of a text, long words, letters of other alphabets."""
    import re

    import pyarrow as pa

    from spanforge.functions import word_pairs

    texts = ["a b a b", "", "one", "é b c", "ends here", "again ends here", "  x\ny\tz  ", "a" * 5000 + " b", "a b", "ab cd", None and "", "1 2 3", "b a-b_a", "i̇ a b"]
    texts = [t or "" for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([5] * len(texts))], names=["text", "kind"]).slice(1)
    got = {}
    for start, n, row, h in word_pairs.cut(batch):
        for r, x in zip(row.tolist(), h.tolist()):
            got.setdefault(start + r, set()).add(x)
    want, named = {}, {}
    for k, text in enumerate(texts[1:]):
        words = re.findall("[a-z]+", text)
        pairs = {f"{x} {y}" for x, y in zip(words, words[1:])}
        if pairs:
            want[k] = pairs
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for x in want:
        assert sorted(h & 3 for h in got[x]) == sorted([3, 2, 1][len(p) % 3] for p in want[x])
        for y in want:
            assert len(got[x] & got[y]) == len(want[x] & want[y])
