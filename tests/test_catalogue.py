"""Every catalogue query that has an oracle gives the oracle's rows."""

import os

import duckdb
import pandas as pd
import pytest

from cairngraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def rows(df: pd.DataFrame) -> list[str]:
    def text(x) -> str:
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(text(y) for y in x) + "]"
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, str):
            return x
        return f"{float(x):.6g}" if not isinstance(x, (bool, pd.Timestamp)) else str(x)

    return sorted("|".join(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.skipif(not TABLES, reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
