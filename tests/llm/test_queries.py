"""Every query with SQL gives its SQL's rows on the smallest tables."""

import duckdb
import pytest

from moments.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    df = queries.QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = con.execute(queries.ORACLES[name])
    at = [[x[0] for x in got.description].index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())
