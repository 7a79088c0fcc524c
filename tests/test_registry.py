"""Every query with an oracle gives the oracle's rows at the smallest size."""

import duckdb
import pytest

from moments.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return con


def norm(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = con.execute(registry.ORACLES[name])
    assert sorted(x[0] for x in got.description) == names
    at = [[x[0] for x in got.description].index(n) for n in names]
    assert norm(tuple(r[n] for n in names) for r in df.collect()) == norm(tuple(r[i] for i in at) for r in got.fetchall())
