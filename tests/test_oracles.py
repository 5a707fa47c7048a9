"""Every registered query against its SQL in an independent engine, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from emberflow.plans import catalogue, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return con


def normal(df):
    out = df[sorted(df.columns)].copy()
    for c in out:
        if pd.api.types.is_float_dtype(out[c]):
            out[c] = out[c].round(6) + 0.0
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]")
        out[c] = out[c].map(lambda x: "~" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x))
    return out.sort_values(list(out)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.sql(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_every_query_has_sql_but_few():
    assert set(catalogue.QUERIES) - set(oracles.SQL) == {"density_core3", "complete_linkage", "isolation_forest"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
