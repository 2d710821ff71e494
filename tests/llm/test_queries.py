"""Queries against their SQL, and what they leave behind."""

import duckdb
import pytest

from lodestrata import steps
from lodestrata.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    before = set(steps.existing())
    ours, theirs = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(tuple(r[c] for c in theirs.columns) for r in ours.collect()) == sorted(theirs.fetchall())
    # the result is the only step that is left, and goes when it is freed
    assert set(steps.existing()) - before == {ours._step}
    steps.free(ours)
    assert set(steps.existing()) == before
