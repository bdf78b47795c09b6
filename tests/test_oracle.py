"""Every query with a SQL twin gives the same rows on the small tables."""

import math

import duckdb
import pytest

from hitsieve.plans.catalog import ORACLES, QUERIES
from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'").fetchall()
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_every_query_is_callable():
    assert set(ORACLES) <= set(QUERIES)
