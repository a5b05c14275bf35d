"""Pricing columns and interval estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the classic five-term polynomial for the normal distribution (absolute error under 7.5e-8).
NORMAL_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_SCALE = 0.2316419
ROOT_2PI = 2.5066282746310002


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_2PI


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + NORMAL_SCALE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(NORMAL_TERMS):
        poly = (poly + c) * t
    tail = normal_density(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_put(forward: Column, strike: Column, vol: Column, years: Column, rate: float = 0.0) -> dict[str, Column]:
    """Price, delta and probability of exercise of a put on a forward; at or past expiry the payoff decides."""
    spread = vol * F.sqrt(years)
    d1 = F.ln(forward / strike) / spread + spread / 2
    d2 = d1 - spread
    discount = F.exp(-rate * years)
    live = years > 0
    return {
        "price": F.when(live, discount * (strike * normal_cdf(-d2) - forward * normal_cdf(-d1))).otherwise(F.greatest(strike - forward, F.lit(0.0))),
        "delta": F.when(live, -discount * normal_cdf(-d1)).otherwise(F.when(forward < strike, F.lit(-1.0)).otherwise(F.lit(0.0))),
        "exercise": F.when(live, normal_cdf(-d2)).otherwise((forward < strike).cast("double")),
    }


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, k = hits / n, F.lit(z * z) / n
    mid, half = (p + k / 2) / (1 + k), F.sqrt(p * (1 - p) / n + k / (4 * n)) * z / (1 + k)
    return mid - half, mid + half


def taxed_yield(y: Column, vat: Column, income_tax: Column) -> Column:
    """The yield that a taxed bond must pay to leave what an exempt one leaves."""
    return y * (1 + vat) / (1 - income_tax)


def net_yield(y: Column, tax: Column) -> Column:
    return y / (1 + tax)


def probability_below(level: Column, forward: Column, vol: Column, years: Column) -> Column:
    """P(price < level) at expiry under a lognormal price with that forward; at or past expiry 1 or 0."""
    spread = vol * F.sqrt(years)
    d2 = F.ln(forward / level) / spread - spread / 2
    return F.when(years > 0, normal_cdf(-d2)).otherwise((forward < level).cast("double"))


def _cdf(x: np.ndarray) -> np.ndarray:
    """``normal_cdf`` of an array, term by term the same."""
    t, poly = 1 / (1 + NORMAL_SCALE * np.abs(x)), 0.0
    for c in reversed(NORMAL_TERMS):
        poly = (poly + c) * t
    tail = np.exp(-x * x / 2) / ROOT_2PI * poly
    return np.where(x >= 0, 1 - tail, tail)


def implied_volatility(price: Column, forward: Column, strike: Column, years: Column, low: float = 1e-4, high: float = 3.0, steps: int = 60) -> Column:
    """Volatility at which ``black_put`` has the price, by halving [low, high]; null outside what that range can give.

    All rows of an Arrow batch are halved at once: as a fold of columns a step would compute the ends' terms over and over.
    ``black_put`` itself decides only on prices that are within rounding of what the range's ends give.
    """

    @F.pandas_udf("vol double, inside int")
    def halved(price: pd.Series, forward: pd.Series, strike: pd.Series, years: pd.Series) -> pd.DataFrame:
        p, f, k, t = (c.to_numpy(float) for c in (price, forward, strike, years))
        with np.errstate(all="ignore"):  # rows out of range are null below
            ratio, root, lo, hi = np.log(f / k), np.sqrt(t), np.full(len(p), low), np.full(len(p), high)

            def value(vol):
                spread = vol * root
                d1 = ratio / spread + spread / 2
                return k * _cdf(spread - d1) - f * _cdf(-d1)

            least, most, slack = value(low), value(high), 1e-9 * (np.abs(f) + np.abs(k))
            inside = np.where((p - least > slack) & (most - p > slack), 1, np.where((least - p > slack) | (p - most > slack), -1, 0))
            for _ in range(steps):
                mid = (lo + hi) / 2
                over = value(mid) > p
                lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
        return pd.DataFrame({"vol": (lo + hi) / 2, "inside": inside})

    found = halved(*(c.cast("double") for c in (price, forward, strike, years)))
    least, most = (black_put(forward, strike, F.lit(v), years)["price"] for v in (low, high))
    return F.when((years > 0) & ((found["inside"] == 1) | ((found["inside"] == 0) & (price >= least) & (price <= most))), found["vol"])
