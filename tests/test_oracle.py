"""Every query that is quick to run against its SQL, over whole tables."""

import duckdb
import pytest

from parchmill.plans import oracle, queries

SF = "/root/testdata/sf0.01"
SQL = oracle.registered()
SLOW = {"assemble_results", "no_cache_run", "stream_documents", "stream_upsert", "corpus_stats_by_host"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("pages", "documents", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(queries.registered())


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = queries.registered()[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(row[c] for c in names)) for row in df.collect())
    assert got == expected
