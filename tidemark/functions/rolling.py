"""Rolling columns over session rows: gaps keep their slot, and each function states what it asks of missing values.

Values are whole numbers (cents, units), so that sums are exact in any order and each result is divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def frame(keys: list[str], rows: int, order: str = "s", last: int = 0) -> WindowSpec:
    """``rows`` session rows that end ``last`` rows from the current one (0: with it, -1: before it)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(last - rows + 1, last)


def ordered(keys: list[str], order: str = "s") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def full(w: WindowSpec, rows: int, value: Column) -> Column:
    """``value`` where the frame holds all its ``rows`` session rows, with values or without; null at a series' start."""
    return F.when(F.count(F.lit(1)).over(w) == rows, value)


def least_share(rows: int, share: float = 0.7) -> int:
    """The number of values that ``share`` of the rows asks for, halves to the even number."""
    return max(1, round(rows * share))


def positive_share(x: Column, w: WindowSpec, least: int) -> Column:
    """100 times the share of values over 0."""
    return F.when(F.count(x).over(w) >= least, 100 * F.count(F.when(x > 0, 1)).over(w) / F.count(x).over(w))


def range_position(x: Column, w: WindowSpec, least: int) -> Column:
    """Where x stands between the frame's minimum (0) and maximum (100); null without spread or under ``least`` values."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (high > low), F.lit(100.0) * (x - low) / (high - low))


def cumulative_slope(x: Column, rows: int, keys: list[str], order: str = "s") -> Column:
    """Least-squares slope over time of the running sum of the last ``rows`` values; null where one is missing.

    A value enters every later point of the path, so the slope is one weighted sum of the values.
    """
    mid = (rows - 1) / 2
    spread = sum((i - mid) ** 2 for i in range(rows))
    w = ordered(keys, order)
    return sum((F.lag(x, rows - 1 - j).over(w) * F.lit(sum(i - mid for i in range(j, rows))) for j in range(rows)), F.lit(0.0)) / spread


def mean_over(x: Column, w: WindowSpec, least: int) -> Column:
    """Mean of the frame's values where at least ``least`` are there, else null."""
    return F.when(F.count(x).over(w) >= least, F.sum(x).over(w) / F.count(x).over(w))


def sum_over(x: Column, w: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(w) >= least, F.sum(x).over(w))


def deviation_over(x: Column, w: WindowSpec, least: int, ddof: int) -> Column:
    """Standard deviation from exact whole sums; null under ``least`` values or without spread.

    Squares and their sums are decimals, as those of large tables pass 64 bits.
    """
    wide = x.cast("decimal(19,0)")
    n, s, q = F.count(x).over(w), F.sum(x).over(w).cast("decimal(19,0)"), F.sum(wide * wide).over(w)
    spread = n * q - s * s
    return F.when((n >= least) & (n > ddof) & (spread > 0), F.sqrt(spread.cast("double") / (n * (n - ddof)).cast("double")))


def zscore_over(x: Column, w: WindowSpec, least: int) -> Column:
    n, s = F.count(x).over(w), F.sum(x).over(w)
    return F.when(x.isNotNull(), ((x * n - s).cast("double") / n.cast("double")) / deviation_over(x, w, least, 1))


def _frame_values(x: Column, w: WindowSpec) -> Column:
    return F.filter(F.transform(F.collect_list(F.struct(x.alias("v"))).over(w), lambda r: r["v"]), lambda v: v.isNotNull())


def percentile_midrank(x: Column, w: WindowSpec, least: int) -> Column:
    """100 (less + equal / 2) / count of the frame's values."""
    values = _frame_values(x, w)
    less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(values) >= least), F.lit(50.0) * (2 * less + same) / F.size(values))


def percentile_strict(x: Column, w: WindowSpec, least: int) -> Column:
    """100 less / (physical rows of the frame - 1): rows without a value count below the line."""
    values = _frame_values(x, w)
    rows = F.size(F.collect_list(F.struct(x.alias("v"))).over(w))
    return F.when(x.isNotNull() & (F.size(values) >= least) & (rows > 1), F.lit(100.0) * F.size(F.filter(values, lambda v: v < x)) / (rows - 1))


def percentile_at_most(x: Column, w: WindowSpec, least: int) -> Column:
    values = _frame_values(x, w)
    return F.when(x.isNotNull() & (F.size(values) >= least), F.lit(100.0) * F.size(F.filter(values, lambda v: v <= x)) / F.size(values))


def gate_signal(percentile: Column, direction: Column, low: float = 40.0, high: float = 60.0) -> Column:
    """1 or -1 outside the band, by ``direction``; 0 inside it or without history."""
    return F.when(percentile.isNull(), F.lit(0)).when(percentile > high, direction).when(percentile < low, -direction).otherwise(F.lit(0)).cast("int")


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank from 1 in which ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / F.lit(2.0)
