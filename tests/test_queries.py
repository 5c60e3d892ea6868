"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sprachwerk.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    return c


def rows(df):
    def text(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_are_those_of_sql(spark, con, data, name):
    ours, theirs = catalogue.QUERIES[name](spark, f"{data}/sf0.001").toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: Queries without SQL and the tests of test_brute_force.py that hold them against plain Python.
BY_HAND = {"sections_of_documents", "sentence_counts", "chunk_structural", "chunk_fixed", "style_report", "hybrid_search", "rag_extractive"}


def test_every_query_has_sql_or_a_brute_force_test():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == BY_HAND


def test_the_entry_point(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
