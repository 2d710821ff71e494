"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, sql, name):
    ours, theirs = catalogue.queries()[name](spark, DATA), sql.sql(catalogue.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in ours.collect())
    assert mine == sorted(repr(tuple(r[theirs.columns.index(c)] for c in order)) for r in theirs.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_rest_works_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'phrase_search' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
