"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from loomgraph import queries as graph_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(graph_queries.QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    rows = sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    if name not in graph_queries.ORACLES:
        assert rows
        return
    found = duck.execute(graph_queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 10
