"""Every registered query with a counterpart in SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quern.plans.registry import ORACLE_SQL, QUERIES
from quern.session import shipped

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return repr(float(v)) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](shipped(spark), SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](shipped(spark), SF).count() > 0
