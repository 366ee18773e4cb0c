"""Every registered query against its DuckDB statement on the smallest test tables."""

import os

import duckdb
import pytest

from checks.compare import _rows
from checks.oracle_sql import SQL
from checks.queries import QUERIES

SF_DIR = os.environ.get("LINEWATCH_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_duckdb(spark, duck, key):
    s_cols, s_rows = _rows(QUERIES[key](spark, SF_DIR).toPandas())
    d_cols, d_rows = _rows(duck.execute(SQL[key]).df())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["station_name", "fail_count", "position"]
    assert df.count() > 0
