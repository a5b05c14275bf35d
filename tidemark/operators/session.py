"""Session calendar, panels on it, as-of joins and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(dates: DataFrame, column: str = "d") -> DataFrame:
    """(d, s): distinct dates with a dense session number from 1. The calendar is small; only it is ordered in one place."""
    days = dates.select(F.col(column).alias("d")).where(F.col(column).isNotNull()).distinct()
    return days.withColumn("s", F.row_number().over(Window.orderBy("d")).cast("long"))


def panel(values: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Every key on every session: ``values`` (keys, d, x) where there is one, else null, which isn't 0."""
    names = values.select(*keys).distinct()
    grid = days.crossJoin(names)
    return grid.join(values, [*keys, "d"], "left").select(*keys, "d", "s", "x")


def asof_backward(left: DataFrame, changes: DataFrame, on: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``changes`` at or before ``on``; null before the first change."""
    keys = keys or []
    both = left.withColumn("__v", F.lit(None).cast(dict(changes.dtypes)[value])).withColumn("__tag", F.lit(1)).unionByName(
        changes.select(*keys, on, F.col(value).alias("__v"), F.lit(0).alias("__tag")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "__tag").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__tag = 1").drop("__v", "__tag")


def interpolate(points: DataFrame, nodes: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """``points`` with ``y`` on the line between the two nodes (keys, node, value) round ``x``; null outside the nodes.

    A curve has few nodes: they travel as one array a curve, so that points are neither sorted nor joined by a range.
    """
    curves = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("__nodes"))
    joined = points.join(curves, keys, "left") if keys else points.crossJoin(curves)
    at, n = F.col(x), F.col("__nodes")
    below = F.size(F.filter(n, lambda p: p["node"] <= at))
    first = F.when(below == F.size(n), below - 1).otherwise(below)
    a, b = F.get(n, first - 1), F.get(n, first)
    y = a["value"] + (b["value"] - a["value"]) * (at - a["node"]) / (b["node"] - a["node"])
    return joined.withColumn("y", F.when((below > 0) & (at <= b["node"]), y)).drop("__nodes")


def forward_label(x: Column, horizon: int, keys: list[str]) -> Column:
    """Change over the next ``horizon`` sessions, known only once they have passed."""
    return F.lead(x, horizon).over(Window.partitionBy(*keys).orderBy("s")) - x
