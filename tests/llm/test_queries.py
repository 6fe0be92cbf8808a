"""Registered queries: those with SQL give the SQL's rows; all give the contract's columns, one row per document."""

import os

import duckdb
import pytest

from arborlex.llm import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "conversations")
COLUMNS = {
    "op1_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op10_licences": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert COLUMNS[name] <= set(got.columns)
    assert sorted(got["doc_id"]) == [r[0] for r in duck.sql("select doc_id from documents order by 1").fetchall()]
