import duckdb
import pytest

from hitsieve.llm.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'").fetchall()
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))
