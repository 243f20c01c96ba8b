"""The queries that SQL can express against DuckDB; and what holds for all of them."""

import glob
import os

import duckdb
import pytest

from foliant.llm.queries import QUERIES
from foliant.llm.sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op1_pii", "op9_exact_dedup"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_one_row_per_document(spark, sf_dir):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    for name in ("op2_token_counts", "op5_licenses", "op7_chunk_dedup", "op8_suffix_dedup", "op1_pii"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()) == ids, name
