"""Planted faults: every planted query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textsync.plans import planted_oracle, planted_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(planted_queries.QUERIES))
def test_planted(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = planted_queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({planted_oracle.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want
