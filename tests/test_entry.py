"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, db, name):
    got = queries.QUERIES[name](spark, small)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert got.columns
        return
    result = db.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
