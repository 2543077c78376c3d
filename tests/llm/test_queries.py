"""Registered queries over the smallest tables: columns, rows, and their SQL where there is one."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canon
from trafficlake.llm import queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"],
    "op2": ["query_id", "rank", "vec_id", "score"],
    "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5": ["doc_id", "size", "source_size", "target", "taken"],
    "op6": ["vec_id", "n_links", "component_id", "kept"],
    "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
    "op8": ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"],
    "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12": ["word", "n", "n_near", "form", "form_n", "root"],
    "op13": ["item_id", "rank", "doc_id", "score"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="generated tables not present")


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_its_columns_and_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert df.columns == COLUMNS[name.split("_")[0]]
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
        assert canon(got).equals(canon(want))


def test_pipeline_runs(spark):
    out = entry.queries()["pipeline"](spark, SF_DIR)
    assert out.columns == COLUMNS["op3"] and out.count() > 0
