"""Every query with an oracle gives the oracle's rows at sf0.001."""

import math

import duckdb
import pytest

from tidegauge import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return x if isinstance(x, str) else float(x)

    return sorted((tuple(cell(x) for x in r) for r in df[names].astype(object).itertuples(index=False, name=None)), key=repr)


PAIRS = {name: (registry.queries()[name], sql) for name, sql in registry.oracle_sql().items()} | registry.examples()


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query_equals_oracle(spark, db, name):
    query, sql = PAIRS[name]
    got, want = rows(query(spark, SF).toPandas()), rows(db.sql(sql).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [x if x is None or isinstance(x, str) else pytest.approx(x, rel=1e-6, abs=1e-6) for x in b] == list(a)
