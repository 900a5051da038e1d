"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from webloom.plans import queries as plans  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, connection, name):
    found = plans.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    if name in plans.oracle_sql():
        want = connection.sql(plans.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
    else:
        assert rows
