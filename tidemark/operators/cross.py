"""Cross-sections: figures over the members of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import average_rank


def consensus(df: DataFrame, value: str, by: list[str], least: int = 5) -> DataFrame:
    """100 (up - down) / (up + down) of the values' signs; null under ``least`` values or where none has a sign."""
    v = F.col(value)
    up, down = F.count_if(v > 0), F.count_if(v < 0)
    return df.groupBy(*by).agg(F.when(F.count(v) >= least, 100 * (up - down) / F.nullif(up + down, F.lit(0))).alias("consensus"))


def cross_rank(df: DataFrame, value: str, by: list[str], name: str, least: int = 5) -> DataFrame:
    """Rows that have a value, with its average-rank percentile (0 to 100) among them; null under ``least`` values."""
    have = df.where(F.col(value).isNotNull())
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return have.withColumn(name, F.when(m >= least, 100 * (average_rank(F.col(value), by) - 1) / (m - 1)))


def concentration_index(df: DataFrame, value: str, by: list[str], least: int = 5, name: str = "hhi") -> DataFrame:
    """100 times the sum of squared shares in the total size; null under ``least`` values or without size."""
    size = F.abs(F.col(value))
    total = df.groupBy(*by).agg(F.count(value).alias("__n"), F.sum(size).alias("__total"))
    share = size / F.col("__total")
    sums = df.join(total, by).groupBy(*by).agg(F.first("__n").alias("__n"), F.first("__total").alias("__total"), F.sum(share * share).alias("__q"))
    return sums.select(*by, F.when((F.col("__n") >= least) & (F.col("__total") > 1e-9), 100 * F.col("__q")).alias(name))


def side_difference(df: DataFrame, member: str, value: str, by: list[str], plus: list[str], minus: list[str], name: str = "side_difference") -> DataFrame:
    """Sum over the members ``plus`` less that over ``minus``; null where any of them lacks a value."""

    def side(names):
        inside = F.when(F.col(member).isin(names), F.col(value))
        return F.when(F.count(inside) == len(names), F.sum(inside))

    return df.groupBy(*by).agg(F.round(side(plus) - side(minus), 6).alias(name))
