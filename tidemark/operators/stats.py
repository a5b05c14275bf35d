"""Statistics over groups: rank correlation, multiple testing, forecast metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.rolling import average_rank


def spearman(df: DataFrame, x: str, y: str, keys: list[str], name: str = "ic") -> DataFrame:
    """Rank correlation per group over rows that have both, ties sharing mean ranks; null under 2 rows or without spread.

    Doubled ranks are whole numbers, so the sums are exact.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, (2 * average_rank(F.col(x), keys)).cast("long").alias("a"), (2 * average_rank(F.col(y), keys)).cast("long").alias("b"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), exact_correlation(F.col("a"), F.col("b")).alias(name))


def exact_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of whole numbers from exact sums (as decimals, so that squares can't overflow)."""
    a, b = a.cast("decimal(18,0)"), b.cast("decimal(18,0)")
    n = F.count(F.lit(1)).cast("double")
    sa, sb, saa, sbb, sab = (F.sum(v).cast("double") for v in (a, b, a * a, b * b, a * b))
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    return F.when((va > 0) & (vb > 0), (n * sab - sa * sb) / (F.sqrt(va) * F.sqrt(vb)))


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of real numbers, of a group or over a frame; null without spread, as ``corr`` divides by it."""
    a, b = a.cast("double"), b.cast("double")
    c, sa, sb, la, ha, lb, hb = (f.over(over) if over is not None else f for f in (F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b), F.min(a), F.max(a), F.min(b), F.max(b)))
    return F.when((la < ha) & (lb < hb), c / F.nullif(sa * sb, F.lit(0.0)))


def adjusted_q(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """``df`` with ``q``: Benjamini-Hochberg values per group; null p are left out of the count and stay null."""
    own = Window.partitionBy(*keys, F.col(p).isNull())
    rank = F.row_number().over(own.orderBy(p))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(own) / F.max("__r").over(Window.partitionBy(*keys, F.col(p).isNull(), p)))
    down = own.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__r", rank).withColumn("__raw", raw).withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__r", "__raw")


def forecast_metrics(pred: Column, actual: Column) -> dict[str, Column]:
    """Counts and errors over rows that have both; direction counts leave zeros out."""
    ok = pred.isNotNull() & actual.isNotNull()
    decided = ok & (pred != 0) & (actual != 0)
    hit = decided & (F.signum(pred) == F.signum(actual))
    return {
        "n": F.count_if(ok),
        "mae": F.avg(F.when(ok, F.abs(pred - actual))),
        "mse": F.avg(F.when(ok, (pred - actual) * (pred - actual))),
        "direction_n": F.count_if(decided),
        "correct": F.count_if(hit),
        "up_recall": F.count_if(hit & (actual > 0)) / F.nullif(F.count_if(decided & (actual > 0)), F.lit(0)),
        "down_recall": F.count_if(hit & (actual < 0)) / F.nullif(F.count_if(decided & (actual < 0)), F.lit(0)),
    }


def _turned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of each row's two arrays: their correlation, and how many of all ways to turn one round do as well in size, itself
    included; null without spread. All turns are one cross-correlation."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.asarray(x, float), np.asarray(y, float)
        size = np.sqrt(((x - x.mean()) ** 2).sum() * ((y - y.mean()) ** 2).sum()) if len(x) else 0.0
        if not size or x.min() == x.max() or y.min() == y.max():
            out.append((None, None))
            continue
        r = np.fft.irfft(np.fft.rfft(y - y.mean()) * np.conj(np.fft.rfft(x - x.mean())), len(x)) / size
        out.append((r[0], int((np.abs(r) >= abs(r[0]) - 1e-12).sum())))
    return pd.DataFrame(out, columns=["ic", "as_good"])


def turned(i: Column, a: Column, b: Column) -> Column:
    """Aggregate: struct (ic, as_good) of ``a`` against ``b`` in order of ``i``, turned round by every number of places."""
    rows = F.array_sort(F.collect_list(F.struct(i.alias("i"), a.cast("double").alias("a"), b.cast("double").alias("b"))))
    return F.pandas_udf(_turned, "struct<ic:double,as_good:long>")(F.transform(rows, lambda r: r["a"]), F.transform(rows, lambda r: r["b"]))


def circular_shift_test(df: DataFrame, x: str, y: str, keys: list[str], order: str = "s") -> DataFrame:
    """(keys, ic, shifts, p): the correlation per group against those with ``y`` turned round by every number of places.

    ``p`` counts the turns that do as well in size, none included; null, as ``ic``, without spread. Rows with a null are
    left out first. A group is as long as its sessions; all its turns are one transform.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), turned(F.col(order), F.col(x), F.col(y)).alias("r"))
    return found.select(*keys, F.col("r.ic").alias("ic"), (F.col("n") - 1).alias("shifts"), (F.col("r.as_good") / F.col("n")).alias("p"))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by its finite sum; null under one degree."""
    odd = df % 2 == 1
    angle = F.atan(F.abs(t) / F.sqrt(df))
    square = F.pow(F.cos(angle), F.lit(2))
    steps = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")

    def add(s, k):
        return F.struct((s["term"] * square * F.when(odd, (2 * k) / (2 * k + 1.0)).otherwise((2 * k - 1) / (2.0 * k))).alias("term"), (s["sum"] + s["term"]).alias("sum"))

    first = F.struct(F.when(odd, F.cos(angle)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))
    turns = F.when(steps >= 0, F.sequence(F.lit(1), steps + 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(turns, first, add)["sum"] * F.sin(angle)
    inside = F.when(odd, (angle + total) * 2 / F.pi()).otherwise(total)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))
