"""Queries that must see all of their input."""

from pyspark.sql import functions as F

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_digest_sees_a_late_change(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey <= 3000")
    more = orders.select((F.col("o_orderkey") + 50_000).alias("o_orderkey"), *orders.columns[1:])
    both = orders.union(more)
    last = both.agg(F.max("o_orderkey")).first()[0]
    status = both.where(F.col("o_orderkey") == last).first()["o_orderstatus"]
    changed = both.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == last, 1.0).otherwise(0.0))
    found = []
    for name, table in (("a", both), ("b", changed)):
        table.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        found.append({r["o_orderstatus"]: r["digest"] for r in registry.QUERIES["digest"](spark, f"{tmp_path}/{name}").collect()})
    assert {s for s in found[0] if found[0][s] != found[1][s]} == {status}


def test_circular_shift_takes_every_shift(spark):
    some = {r["yr"]: r for r in registry.QUERIES["circular_shift_p"](spark, SF).collect()}
    every = registry.QUERIES["circular_shift_rank_p"](spark, SF).collect()
    assert every and all(r["shifts"] == some[r["yr"]]["shifts"] + 1 for r in every)  # the one counts the shift by 0 too
    assert max(r["shifts"] for r in every) > 100
    assert all(r["p"] is None or 1 / r["shifts"] <= r["p"] <= 1 for r in every)
