"""Pricing columns."""

import time

from pyspark.sql import functions as F

from tidemark.functions import finance as N
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_implied_volatility_of_many_rows(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.crossJoin(spark.range(300).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * 1200).drop("i").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    got = registry.QUERIES["implied_volatility"](spark, str(tmp_path)).agg(F.count("vol"), F.count_if(F.col("vol") == F.round(0.15 + F.col("p_partkey") % 4 / 20.0, 5))).first()
    assert got[0] == got[1] == part.count() * 300
    assert time.time() - began < 45  # a fold of columns takes milliseconds a row


def test_implied_volatility_at_and_outside_the_ends(spark):
    rows = [(100.0, 100.0, 1e-4, 1.0), (100.0, 100.0, 3.0, 1.0), (100.0, 90.0, 3.0, 0.5), (100.0, 101.0, 1.25, 2.0), (7.0, 7.001, 1e-4, 0.7)]
    made = spark.createDataFrame(rows, "f double, k double, v double, t double")
    made = made.withColumn("price", N.black_put(F.col("f"), F.col("k"), F.col("v"), F.col("t"))["price"])
    vol = N.implied_volatility(F.col("price"), F.col("f"), F.col("k"), F.col("t"))
    assert all(abs(r["vol"] - r["v"]) < 1e-6 for r in made.select("v", vol.alias("vol")).collect())
    odd = [(1.0, 100.0, 120.0, 1.0), (119.9, 100.0, 120.0, 1.0), (5.0, 100.0, 100.0, 0.0), (None, 100.0, 100.0, 1.0), (5.0, None, 100.0, 1.0), (float("nan"), 100.0, 100.0, 1.0)]
    none = spark.createDataFrame(odd, "price double, f double, k double, t double")
    assert [r[0] for r in none.select(N.implied_volatility(F.col("price"), F.col("f"), F.col("k"), F.col("t"))).collect()] == [None] * len(odd)
