"""Every query of the event engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from semevents.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows([c[0] for c in want.description], want.fetchall())
