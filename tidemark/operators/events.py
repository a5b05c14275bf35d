"""Threshold events, bands and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered


def cross_ups(df: DataFrame, value: str, threshold: float, keys: list[str], order: str = "s") -> DataFrame:
    """Rows on which ``value`` is over ``threshold`` and wasn't on the row before (it re-arms when it falls back)."""
    before = F.lag(value).over(ordered(keys, order))
    return df.withColumn("__b", before).where((F.col(value) > threshold) & (F.col("__b") <= threshold)).drop("__b")


def grid_scan(df: DataFrame, value: str, target: str, thresholds: list[float], windows: list[int], lag: int = 0, order: str = "s", least: int = 5) -> DataFrame:
    """(threshold, window, n, mean, t, win_rate) of the target's fall from ``lag`` to ``lag`` + window rows after each cross-up.

    Prices after each row come as frame columns, one a window; the grid is a list of thresholds a row, not a join.
    """
    w = ordered([], order)
    start = F.lead(target, lag).over(w) if lag else F.col(target)
    ahead = F.array(*[F.struct(F.lit(n).alias("window"), (start - F.lead(target, lag + n).over(w)).alias("r")) for n in windows])
    rows = df.withColumn("before", F.lag(value).over(w)).withColumn("ahead", ahead)
    crossed = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("before <= threshold").where(F.col(value) > F.col("threshold"))
    each = crossed.select("threshold", F.explode("ahead").alias("a")).select("threshold", "a.window", F.col("a.r").cast("double").alias("r")).where("r is not null")
    n, mean, sd = F.count(F.lit(1)), F.avg("r"), F.stddev_samp("r")
    return each.groupBy("threshold", "window").agg(n.alias("n"), mean.alias("mean"), F.when(sd > 0, mean / (sd / F.sqrt(n))).otherwise(0.0).alias("t"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate")).where(F.col("n") >= least)


def drawdown_events(df: DataFrame, value: str, trigger: float, horizon: int, cooldown: int, touch: float, rows: int = 250, order: str = "s") -> DataFrame:
    """Falls through ``-trigger`` under the rolling high, at least ``cooldown`` rows after the last accepted one, with the
    worst and the final return over the next ``horizon`` rows and whether the worst reaches ``-touch``.

    Which crossings are accepted depends on the one before, so they, few as they are, are folded in order; their windows
    are frame columns.
    """
    w = ordered([], order)
    high = F.max(value).over(Window.orderBy(order).rowsBetween(1 - rows, 0))
    next_ = Window.orderBy(order).rowsBetween(1, horizon)
    x = F.col(value)
    at = df.withColumn("dd", x / high - 1).withColumn("before", F.lag("dd").over(w)).withColumn("i", F.row_number().over(w) - 1)
    at = at.withColumn("worst", F.min(value).over(next_) / x - 1).withColumn("terminal", F.lead(value, horizon).over(w) / x - 1)
    crossed = at.where((F.col("dd") <= -trigger) & (F.col("before") > -trigger) & F.col("terminal").isNotNull())
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.col("i"))),
        F.array().cast("array<int>"),
        lambda kept, i: F.when((F.size(kept) == 0) | (i - F.try_element_at(kept, F.lit(-1)) >= cooldown), F.array_append(kept, i)).otherwise(kept),
    )
    accepted = crossed.agg(fold.alias("kept")).select(F.explode("kept").alias("i"))
    return crossed.join(accepted, "i").select(order, "dd", "worst", "terminal", (F.col("worst") <= -touch).alias("touched"))


def bands(df: DataFrame, a: str, b: str, order: str = "s") -> DataFrame:
    """(band, sign, first, last, n): runs of rows on which both values, as z over all rows shown, have one sign."""
    w = Window.partitionBy()
    z = [(F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)) for c in (a, b)]
    signed = df.withColumn("za", z[0]).withColumn("zb", z[1]).withColumn("sign", F.when((F.col("za") > 0) & (F.col("zb") > 0), 1).when((F.col("za") < 0) & (F.col("zb") < 0), -1).otherwise(0))
    run = F.row_number().over(Window.orderBy(order)) - F.row_number().over(Window.partitionBy("sign").orderBy(order))
    return signed.withColumn("run", run).where("sign <> 0").groupBy("sign", "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")
