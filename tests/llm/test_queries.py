"""The registered queries on the smallest tables: their columns, and their rows where SQL states them."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")

FIRST = {
    "op1": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "fingerprint", "component_id"],
    "op6": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["page_id", "url", "text", "n_chars"],
    "op10": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, FOLDER)
    first = FIRST.get(name.split("_")[0], [])
    assert out.columns[: len(first)] == first
    if first:
        assert out.count() == spark.read.parquet(f"{FOLDER}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, FOLDER).toPandas()
    names = sorted(got.columns)
    assert names == sorted(expected.columns) and len(got) > 0
    assert sorted(got[names].itertuples(index=False, name=None)) == sorted(expected[names].itertuples(index=False, name=None))
