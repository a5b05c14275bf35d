"""Values of large tables, whose squares pass 64 bits, held to the queries' SQL in 128 bits."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry

SF = "/root/testdata/sf0.01"
NAMES = ["rolling_z250", "z_difference", "rolling_z60", "signal_figures", "trailing_z", "z_groups"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Orders by week, 100 times as dear: about the sums of a day at 60 times sf0.1."""
    folder = str(tmp_path_factory.mktemp("large"))
    week, price = F.date_trunc("week", "o_orderdate").alias("o_orderdate"), (F.col("o_totalprice") * 100).alias("o_totalprice")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.select("o_orderkey", "o_custkey", "o_orderstatus", price, week, "o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_large_values_match_wide_sql(spark, large, name):
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{large}/orders.parquet/*.parquet'")
    with pytest.raises(duckdb.Error):  # the SQL itself counts in 64 bits
        duck.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, large).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name].replace("AS BIGINT)", "AS HUGEINT)")).df()[list(got.columns)]
    keys = [c for c in ("k", "s") if c in got.columns]
    got, want = (df.sort_values(keys).reset_index(drop=True) for df in (got, want))
    assert got.drop(columns=keys).notna().to_numpy().sum() >= 5
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=0)
