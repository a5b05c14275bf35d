"""A linear model whose state is carried on at a discount, over a grid of discounts and prior spreads, by window sums.

In information form an update adds a row's cross-products to the state's precision, and carrying the state on for a session
multiplies that precision by the discount. So the state at a session is a weighted sum of cross-products of the rows taken in
so far: running sums over the sessions of a key, one set a discount. Prior spreads share them. What is left is one small
linear system a row, solved many side by side in Arrow batches; no key is a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.finance import normal_cdf
from tidemark.functions.rolling import ordered

#: Half the width of the middle 80 % of a normal distribution.
Z80 = 1.2815515655446004


def _products(names: list[str]) -> list[tuple[str, Column]]:
    return [(f"__{i}_{j}", F.col(a) * F.col(b)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]


def _square(batch: pd.DataFrame, size: int, prefix: str = "__") -> np.ndarray:
    out = np.zeros((len(batch), size, size))
    for i in range(size):
        for j in range(i, size):
            out[:, i, j] = out[:, j, i] = batch[f"{prefix}{i}_{j}"].to_numpy(float)
    return out


def spaced(df: DataFrame, keys: list[str], place: str, since: str, apart: int) -> DataFrame:
    """(keys, place): of each key's places the first that is ``apart`` or more after ``since``, the first ``apart`` after that, and so on."""
    types = dict(df.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        last, kept = int(group[since].iloc[0]), []
        for at in np.sort(group[place].to_numpy()):
            if at >= last + apart:
                kept.append(at)
                last = at
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(kept) for k in keys}, place: kept})

    return df.select(*keys, place, since).groupBy(*keys).applyInPandas(pick, ", ".join(f"{c} {types[c]}" for c in (*keys, place)))


def priors(rows: DataFrame, keys: list[str], features: list[str], penalty: float) -> DataFrame:
    """(keys, last, n, state, noise, __i_j): of each key's training rows (__i, features, __y) the last place, the ridge state (the
    mean of y, then weights of y less its mean), the mean squared residual (1e-6 at least) and the penalised cross-products.

    Keys with no more rows than features have none.
    """
    types, size = dict(rows.dtypes), len(features) + 2
    one = rows.withColumn("__one", F.lit(1.0))
    names = ["__one", *features, "__y"]
    sums = one.groupBy(*keys).agg(F.max("__i").alias("last"), F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(c) for c, e in _products(names)]).where(F.col("n") > len(features))
    pairs = [f"__{i}_{j}" for i in range(size - 1) for j in range(i, size - 1)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m, n = _square(b, size), b["n"].to_numpy(float)
            zz, z, zy, mean = m[:, 1:-1, 1:-1] + penalty * np.eye(size - 2), m[:, 0, 1:-1], m[:, 1:-1, -1], m[:, 0, -1] / n
            weights = np.linalg.solve(zz, (zy - z * mean[:, None])[:, :, None])[:, :, 0]
            state = np.column_stack([mean, weights])
            residual = m[:, -1, -1] - 2 * np.einsum("ri,ri->r", state, m[:, :-1, -1]) + np.einsum("ri,rij,rj->r", state, m[:, :-1, :-1], state)
            out = b[[*keys, "last", "n", *pairs]].copy()
            for i in range(1, size - 1):
                out[f"__{i}_{i}"] += penalty
            yield out.assign(state=list(state), noise=np.maximum(residual / n, 1e-6))

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["last long, n long"] + [f"{p} double" for p in pairs] + ["state array<double>, noise double"])
    return sums.mapInPandas(solve, schema)


def filter_grid(df: DataFrame, keys: list[str], order: str, features: list[str], label: str, start: int, discounts: list[float], spreads: list[float], delay: int = 6, penalty: float = 15.0) -> DataFrame:
    """(keys, order, place, y, discount, spread, mean, sd, updated): forecasts of ``label`` at each session from place ``start`` (0 a
    key's first session) for every discount and spread; mean and sd are null where a feature is.

    The prior is a ridge fit on the rows whose label is known before ``start``, its covariance ``spread`` times the fit's. The
    label of a session is known ``delay`` sessions later; labels are taken in at least ``delay`` apart, the first that long
    after the last training row. ``updated`` says that one was taken in at this session. Features should be standardised.
    Nothing later is seen: a series cut short gives the same rows. A discount must be in (0, 1] and a spread over 0, and
    sessions x log(1 / discount) stay under 600, else the weights leave the range of doubles. Keys with fewer training rows
    than parameters have no rows.
    """
    if not all(0 < d <= 1 for d in discounts) or not all(c > 0 for c in spreads):
        raise ValueError("a discount must be in (0, 1] and a spread over 0")
    types, size, names = dict(df.dtypes), len(features) + 1, ["__one", *features, "__y"]
    ok = F.col("__y").isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    rows = df.select(*keys, order, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("__y"))
    rows = rows.withColumns({"__i": (F.row_number().over(ordered(keys, order)) - 1).cast("long"), "__one": F.lit(1.0), "__ok": ok})
    prior = priors(rows.where(F.col("__ok") & (F.col("__i") < start - delay)), keys, features, penalty)
    later = rows.where("__ok").join(prior.select(*keys, "last"), keys).where(F.col("__i") > F.col("last"))
    taken = spaced(later, keys, "__i", "last", delay).withColumn("__taken", F.lit(True))
    at = rows.join(prior.select(*keys, "last", "state", "noise"), keys).join(taken, [*keys, "__i"], "left")
    use = F.col("__taken")  # rows after the last training row are at most a delay before the start, so none of these is known sooner
    each = at.withColumn("discount", F.explode(F.array(*[F.lit(float(d)) for d in discounts])))
    each = each.withColumn("__w", F.pow("discount", (F.col("last") - F.col("__i")).cast("double")))
    known = Window.partitionBy(*keys, "discount").orderBy("__i").rangeBetween(Window.unboundedPreceding, -delay)
    here = Window.partitionBy(*keys, "discount").orderBy("__i").rangeBetween(-delay, -delay)
    sums = [F.coalesce(F.sum(F.when(use, F.col("__w") * e)).over(known), F.lit(0.0)).alias(f"u{c}") for c, e in _products(names)[:-1]]
    run = each.select(*keys, order, *features, "__y", "__i", "discount", "__w", "state", "noise", F.coalesce(F.bool_or(use).over(here), F.lit(False)).alias("updated"), *sums)
    run = run.where(F.col("__i") >= start).join(prior.drop("last", "n", "state", "noise"), keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            x = np.column_stack([np.ones(len(b)), b[features].to_numpy(float)])
            whole = ~np.isnan(x).any(axis=1)
            if not len(b):
                continue
            added, base = _square(b, size, "u__"), _square(b, size)
            moved = np.column_stack([b[f"u__{i}_{size}"].to_numpy(float) for i in range(size)])
            state, noise, weight = np.stack(b["state"].to_numpy()), b["noise"].to_numpy(float), b["__w"].to_numpy(float)
            for c in spreads:
                system, right = base / c + added, np.einsum("rij,rj->ri", base, state) / c + moved
                solved = np.linalg.solve(system, np.stack([right, np.where(whole[:, None], x, 0.0)], axis=2))
                mean = np.einsum("ri,ri->r", x, solved[:, :, 0])
                var = noise * (1 + np.einsum("ri,ri->r", x, solved[:, :, 1]) * weight)
                out = b[[*keys, order]].assign(place=b["__i"], y=b["__y"], discount=b["discount"], spread=float(c))
                yield out.assign(mean=np.where(whole, mean, np.nan), sd=np.where(whole, np.sqrt(np.maximum(var, 1e-12)), np.nan), updated=b["updated"])

    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, order)] + ["place long, y double, discount double, spread double, mean double, sd double, updated boolean"])
    made = run.mapInPandas(solve, schema)
    return made.select(*keys, order, "place", F.nanvl("y", F.lit(None).cast("double")).alias("y"), "discount", "spread", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("mean", "sd")], "updated")


def grid_errors(grid: DataFrame, keys: list[str], until: int, delay: int = 6) -> DataFrame:
    """(keys, discount, spread, n, rmse, chosen): the error of each pair on the labels known before place ``until``. The least error
    is chosen, in ten digits; of equal ones the higher discount, then the lower spread. Later rows have no say."""
    valid = grid.where((F.col("place") + delay < until) & F.col("y").isNotNull() & F.col("mean").isNotNull())
    error = valid.groupBy(*keys, "discount", "spread").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("mean") - F.col("y"), F.lit(2)))).alias("rmse"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("rmse", 10), F.desc("discount"), "spread"))
    return error.withColumn("chosen", first == 1)


def chosen_forecasts(grid: DataFrame, errors: DataFrame, keys: list[str], since: int) -> DataFrame:
    """The rows of ``grid`` from place ``since`` for each key's chosen pair, with the probability of a rise and the middle 80 % interval."""
    best = errors.where("chosen").select(*keys, "discount", "spread")
    rows = grid.where(F.col("place") >= since).join(best, [*keys, "discount", "spread"])
    half = F.lit(Z80) * F.col("sd")
    return rows.withColumns({"up": normal_cdf(F.col("mean") / F.col("sd")), "low": F.col("mean") - half, "high": F.col("mean") + half})
