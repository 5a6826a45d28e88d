"""Every registered query against its DuckDB SQL on whole small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from marlstone.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df:
        number = pd.api.types.is_float_dtype(df[c])
        df[c] = [None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else repr(round(float(v), 9)) if number else str(v) for v in df[c]]
    return sorted(df.itertuples(index=False, name=None), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, oracle, name):
    got, want = QUERIES[name](spark, sf).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    for c in set(got.columns) & set(want.columns):  # whole numbers with nulls come as floats from either side
        if pd.api.types.is_float_dtype(got[c]) != pd.api.types.is_float_dtype(want[c]):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
