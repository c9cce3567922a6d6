"""Registered queries against their SQL, at the smallest scale."""

import collections
import os

import pytest

from glosspan.plans.oracles import ORACLES
from glosspan.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object)
    return columns, collections.Counter(map(repr, map(tuple, values.where(values.notna(), None).to_numpy().tolist())))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)
