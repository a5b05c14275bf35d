"""Recursive indicators and volatility: one grouped pass over each key's own rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered


def per_key(df: DataFrame, keys: list[str], order: str, value: str, out: list[str], function) -> DataFrame:
    """(keys, order, out columns): ``function`` of a key's values in order (numpy, NaN where missing) gives one array a column.

    What depends on all of the past can't be cut into frames; a key's values, one double a session, are what a task holds.
    """
    types = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        found = function(group[value].to_numpy(float))
        return pd.DataFrame({**{c: group[c].to_numpy() for c in (*keys, order)}, **dict(zip(out, found, strict=True))})

    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, order)] + [f"{c} double" for c in out])
    made = df.select(*keys, order, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(run, schema)
    return made.select(*keys, order, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in out])


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    out, now, a = np.full(len(x), np.nan), np.nan, 2 / (span + 1)
    for t, v in enumerate(x):
        if not np.isnan(v):
            now = v if np.isnan(now) else (1 - a) * now + a * v
            out[t] = now
    return out


def macd(df: DataFrame, value: str, keys: list[str], order: str = "s", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(keys, order, macd): difference of two exponential means less its own exponential mean; gaps are skipped."""

    def run(x):
        d = _ema(x, fast) - _ema(x, slow)
        return [d - _ema(d, signal)]

    return per_key(df, keys, order, value, ["macd"], run)


def rsi(df: DataFrame, value: str, keys: list[str], order: str = "s", span: int = 14) -> DataFrame:
    """(keys, order, rsi): relative strength with smoothed gains and losses; a gap starts it anew."""

    def run(x):
        out, seen, up, down = np.full(len(x), np.nan), [], None, None
        for t in range(1, len(x)):
            step = x[t] - x[t - 1]
            if np.isnan(step):
                seen, up, down = [], None, None
                continue
            gain, loss = max(step, 0.0), max(-step, 0.0)
            if up is None:
                seen.append((gain, loss))
                if len(seen) < span:
                    continue
                up, down = np.mean(seen, axis=0)
            else:
                up, down = ((span - 1) * up + gain) / span, ((span - 1) * down + loss) / span
            out[t] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        return [out]

    return per_key(df, keys, order, value, ["rsi"], run)


def volatility(change: Column, keys: list[str], rows: int, yearly: float, ddof: int, order: str = "s") -> Column:
    """Deviation of the last ``rows`` changes, all there, times the root of ``yearly``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    deviation = (F.stddev_pop(change) if ddof == 0 else F.stddev_samp(change)).over(w)
    return F.when(F.count(change).over(w) == rows, deviation * F.sqrt(F.lit(float(yearly))))


def percent_change(x: Column, rows: int, keys: list[str], order: str = "s") -> Column:
    before = F.lag(x, rows).over(ordered(keys, order))
    return F.when(before != 0, (x / before - 1) * 100)


def carry(legs: DataFrame, weights: dict[str, float], key: str, day: str, rate: str, fund: str, name: str = "carry") -> DataFrame:
    """(day, carry): 100 times the weighted sum of each leg's rate over the funding rate; null where a leg is missing."""
    w = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    some = legs.where(F.col(key).isin(list(weights)))
    full = F.count(F.when(F.col(rate).isNotNull() & F.col(fund).isNotNull(), 1)) == len(weights)
    return some.groupBy(day).agg(F.when(full, 100 * F.sum(F.element_at(w, F.col(key)) * (F.col(rate) - F.col(fund)))).alias(name))
