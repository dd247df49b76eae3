"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from palimpsest.plans import registry

#: Queries that an oracle can't express; they run and their own tests look at values.
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLES))


def shown(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str([shown(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, tiny, duck, name):
    got = registry.QUERIES[name](spark, tiny)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table_of([tuple(r) for r in got.collect()], got.columns) == table_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


@pytest.mark.parametrize("name", ["snk_latex", "ocr_tier"])
@pytest.mark.parametrize("texts", [["", " \n"], [None], ["", None, "Plain words of a document."], []], ids=["blank", "null", "mixed", "none"])
def test_texts_without_words_match_sql(spark, tmp_path, name, texts):
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    for i, text in enumerate(texts):
        c.execute("insert into documents values (?, ?, 'en', 'web', ?)", [i, text, len(text or "")])
    c.sql(f"copy documents to '{tmp_path}/documents.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert table_of([tuple(r) for r in got.collect()], got.columns) == table_of(c.sql(registry.ORACLES[name]).fetchall(), got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
