"""Every query with SQL gives the rows of its SQL; the others run."""

import os

import pytest

from loomtext.plans import linking_queries, more_queries, table_queries  # noqa: F401
from loomtext.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in ORACLES:
        assert rows
        return
    said = duck.execute(ORACLES[name])
    columns = [d[0] for d in said.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in said.fetchall())
