"""Series and panels over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.session import calendar, panel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.to_date("o_orderdate").alias("d"), F.substring("o_orderpriority", 1, 1).alias("k"), F.col("o_orderstatus").alias("st"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, d, x): mean order value of every session in whole units; no gaps."""
    o = orders_by_day(spark, sf_dir)
    daily = o.groupBy("d").agg(F.expr("sum(c) div (count(1) * 100)").alias("x"))
    return daily.join(F.broadcast(calendar(o)), "d").select("s", "d", "x")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, d, s, x): order value by priority and session in whole units; sessions without an order are null."""
    o = orders_by_day(spark, sf_dir)
    values = o.groupBy("k", "d").agg(F.expr("sum(c) div 100").alias("x"))
    return panel(values, calendar(o), ["k"])
