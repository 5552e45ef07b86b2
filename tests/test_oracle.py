"""Every query with a SQL twin against that twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


#: Tables on which half of the issues have no vector, some vectors no issue, and models differ in width.
MIXED = "/root/testdata/sf0.01"
ON_MIXED = (
    "triage_propose", "missing_vectors", "embedding_coverage", "similar_refresh", "cascade_orphans", "vector_search",
    "vector_search_stored", "hybrid_search", "stream_embed", "locked_entities", "mask_corpus",
)


def _tables(folder):
    connection = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return connection


@pytest.fixture(scope="module")
def con():
    return _tables(SF)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7) + 0.0
    return value


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


def _compare(spark, con, name, folder):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(_plain(row[c]) for c in columns)) for row in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(_plain(row[i]) for i in at)) for row in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    _compare(spark, con, name, SF)


@pytest.mark.parametrize("name", ON_MIXED)
def test_same_rows_with_missing_vectors(spark, name):
    with _tables(MIXED) as tables:
        _compare(spark, tables, name, MIXED)


def test_entry_is_the_hybrid_search(spark):
    assert {"query_id", "issue_id", "rank", "score"} <= set(entry.entry(spark).columns)
