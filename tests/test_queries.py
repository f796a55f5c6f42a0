"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    in_order = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    assert in_order(got.collect(), columns) == in_order(want.fetchall(), [names.index(c) for c in columns])
