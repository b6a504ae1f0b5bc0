"""Every query with a DuckDB twin gives the twin's rows."""

import os

import duckdb
import pandas as pd
import pytest

from skeinwork.plans.registry import plans

PLANS = plans()


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("NULL" if v is None or (isinstance(v, float) and v != v) else f"{float(v):.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql and not n.startswith("model_mirror")))
def test_twin(name, spark, sf, duck):
    query, sql = PLANS[name]
    got, want = query(spark, sf).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert isinstance(got, pd.DataFrame)
