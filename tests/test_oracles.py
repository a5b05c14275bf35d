"""Every registered query of the library's own that has SQL against it."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object and len(df) and hasattr(df[c].dropna().iloc[0] if len(df[c].dropna()) else None, "__len__") and not isinstance(df[c].dropna().iloc[0], str):
            df[c] = df[c].map(lambda v: str(list(v)))
        elif str(df[c].dtype).startswith(("datetime", "object")):
            df[c] = df[c].map(lambda v: v if isinstance(v, str) or pd.isna(v) else str(v)[:19].replace("T", " ").removesuffix(" 00:00:00"))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(registry.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(registry.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-12, atol=0)
