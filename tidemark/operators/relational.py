"""Ingest and cleaning operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_number(text: Column) -> Column:
    """Numbers with thousands commas; dashes, blanks and other text are null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def keep_last(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def remap(df: DataFrame, column: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """``column`` through the small map ``table``; values without an entry pass."""
    m = table.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    return df.join(m, df[column] == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def weighted_rate(rate: Column, amount: Column) -> Column:
    """Sum(rate amount) / sum(amount) over rows that have both and an amount other than 0."""
    ok = rate.isNotNull() & amount.isNotNull() & (amount != 0)
    return F.sum(F.when(ok, rate * amount)) / F.nullif(F.sum(F.when(ok, amount)), F.lit(0))


def fill_gaps(main: DataFrame, backup: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """``main`` and those rows of ``backup`` within [low, high] whose key it lacks."""
    return main.unionByName(backup.where(F.col(key).between(low, high)).join(main.select(key).distinct(), key, "left_anti"))
