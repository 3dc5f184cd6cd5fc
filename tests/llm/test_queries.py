"""The registered queries on a small table: against DuckDB where there is SQL, against plain versions elsewhere."""

from collections import Counter

import duckdb
import pytest

from spanforge.llm import queries

from . import brute

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, db, name):
    got = queries.queries()[name](spark, small)
    result = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == Counter(tuple(map(plain, r)) for r in rows)


def test_op8_against_plain(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op8_suffix_array_dedup(spark, small).collect()
    assert Counter(map(tuple, got)) == Counter(brute.suffix(rows))


def test_op2_and_op3_give_every_document(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    packed = queries.op2_packing(spark, small).collect()
    assert len(packed) == n and max(Counter((r.bucket, r.batch, r.slot) for r in packed).values()) == 1
    scored = queries.op3_lm_scoring(spark, small).collect()
    assert len(scored) == n and all(r.pseudo_log_likelihood <= 0 for r in scored)
