"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trafficlake import queries as library
from tools.check_oracle import TABLES, canon

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = library.QUERIES, library.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got).equals(canon(want))
