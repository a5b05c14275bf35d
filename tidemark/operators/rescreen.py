"""Walk-forward ridge models whose features are screened again at every fit, from sums of cross-products by block of sessions.

A row goes into the block of the first fit that knows its label; a block is one row of sums. What a fit trains on is a running
sum of blocks, what it screens on the sum of the last few, so rows are read once however many fits there are. Each fit is then
one small screen and one small linear system, many side by side in Arrow batches; no key is a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered


def placed(df: DataFrame, keys: list[str], order: str, features: list[str], level: str, horizon: int, least: int, every: int, fit_at: int | None) -> DataFrame:
    """``df`` with its place in the key, label, and the block that its label and its own session fall into; keys with under ``least`` labels go."""
    w = ordered(keys, order)
    rows = df.select(*keys, order, F.col(level).cast("double").alias("__level"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = rows.withColumns({"__i": (F.row_number().over(w) - 1).cast("long"), "__y": F.lead("__level", horizon).over(w) - F.col("__level")})
    nth = F.count("__y").over(w.rowsBetween(Window.unboundedPreceding, 0))
    enough = F.min(F.when(nth >= least, F.col("__i") + horizon)).over(Window.partitionBy(*keys))
    first = enough if fit_at is None else F.when(enough <= fit_at, F.lit(fit_at).cast("long"))
    rows = rows.withColumn("__first", first).where(F.col("__first").isNotNull())
    since = F.col("__i") - F.col("__first")
    block = F.ceil((since + horizon) / F.lit(every)) if fit_at is None else F.when(since + horizon <= 0, 0).otherwise(None)
    fit = F.floor(since / F.lit(every)) if fit_at is None else F.when(since > 0, 0)
    return rows.withColumns({"__block": block.cast("long"), "__fit": fit.cast("long")})


def _sums(features: list[str]) -> dict:
    """Sums by name over the rows that have both of a pair of features (or a feature and the label): their products, rows, the first's values and squares."""
    names = [*features, "__y"]
    out = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            have = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("__y").isNotNull()
            if i <= j:
                out[f"p{i}_{j}"] = F.sum(F.when(have, F.col(a) * F.col(b)))
                out[f"n{i}_{j}"] = F.sum(F.when(have, F.lit(1.0)))
            out[f"s{i}_{j}"] = F.sum(F.when(have, F.col(a)))
            out[f"q{i}_{j}"] = F.sum(F.when(have, F.col(a) * F.col(a)))
    return out


def _matrices(batch: pd.DataFrame, size: int, prefix: str) -> tuple[np.ndarray, ...]:
    p, n, s, q = (np.zeros((len(batch), size, size)) for _ in range(4))
    for i in range(size):
        for j in range(size):
            lo, hi = min(i, j), max(i, j)
            p[:, i, j], n[:, i, j] = batch[f"{prefix}p{lo}_{hi}"], batch[f"{prefix}n{lo}_{hi}"]
            s[:, i, j], q[:, i, j] = batch[f"{prefix}s{i}_{j}"], batch[f"{prefix}q{i}_{j}"]
    return p, n, s, q


def _correlations(p: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pearson's correlation of each pair over the rows that have both; nan where a side is constant or there are under two rows."""
    n = np.where(n > 1, n, np.nan)
    mean, square = s / n, q / n
    var = np.where(square - mean**2 > 1e-12 * square, square - mean**2, np.nan)
    return (p / n - mean * np.swapaxes(mean, -1, -2)) / np.sqrt(var * np.swapaxes(var, -1, -2))


def screened(score: np.ndarray, share: np.ndarray, likeness: np.ndarray, candidates: list[int], most: int, floor: float, coverage: float, rho: float) -> list[int]:
    """Candidates in order of |score| (six digits; ties: the earlier), those under ``floor``, under ``coverage`` or at ``rho`` or more to one already taken left out."""
    fine = [c for c in candidates if np.isfinite(score[c]) and round(abs(score[c]), 6) >= floor and share[c] >= coverage]
    taken: list[int] = []
    for c in sorted(fine, key=lambda c: (-round(abs(score[c]), 6), c)):
        if len(taken) < most and all(not round(abs(likeness[c, t]), 6) >= rho for t in taken):
            taken.append(c)
    return taken


def refits(rows: DataFrame, keys: list[str], baselines: list[str], candidates: list[str], window: int, every: int, most: int, floor: float, coverage: float, rho: float, penalty: float) -> DataFrame:
    """(keys, fit, n_train, arm, level, selected, mean, weight): each fit's two models, ``baseline`` and ``full`` (with the candidates selected).

    ``mean`` and ``weight`` hold a number a feature, weight 0 where it isn't used. A missing value counts as the training mean;
    features are scaled by their deviation over the rows that have them, the mean of y isn't penalised.
    """
    features, types = [*baselines, *candidates], dict(rows.dtypes)
    size, sums = len(features) + 1, _sums(features)
    blocks = rows.select(*keys, F.col("__block").alias("__b"), *features, "__y").unionByName(rows.where(F.col("__fit") >= 0).select(*keys, F.col("__fit").alias("__b")).distinct(), allowMissingColumns=True)
    held = blocks.where(F.col("__b").isNotNull()).groupBy(*keys, "__b").agg(*[F.coalesce(e, F.lit(0.0)).alias(c) for c, e in sums.items()])
    by = Window.partitionBy(*keys).orderBy("__b")
    upto, last = by.rowsBetween(Window.unboundedPreceding, 0), by.rangeBetween(1 - window // every, 0)
    summed = held.select(*keys, "__b", *[F.sum(c).over(upto).alias(f"t{c}") for c in sums], *[F.sum(c).over(last).alias(f"w{c}") for c in sums]).where(F.col("__b") >= 0)
    base, cand = list(range(len(baselines))), list(range(len(baselines), len(features)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            recent = _matrices(b, size, "w")
            like, wn = _correlations(*recent), recent[1]
            p, n, s, _ = _matrices(b, size, "t")
            out: list[tuple] = []
            for r in range(len(b)):
                rows_y = max(wn[r, -1, -1], 1.0)
                chosen = screened(like[r, :, -1], np.diag(wn[r]) / rows_y, like[r], cand, most, floor, coverage, rho)
                have = np.maximum(np.diag(n[r]), 1.0)
                mean = np.diag(s[r]) / have
                var = np.diag(p[r]) / have - mean**2
                sd = np.where(var > 1e-12 * np.maximum(np.diag(p[r]) / have, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
                centred = p[r] - s[r] * mean[None, :] - s[r].T * mean[:, None] + n[r] * np.outer(mean, mean)
                scaled = centred / np.outer(sd, sd)
                for arm, use in (("baseline", base), ("full", base + chosen)):
                    weight = np.zeros(size - 1)
                    if use:
                        weight[use] = np.linalg.solve(scaled[np.ix_(use, use)] + penalty * np.eye(len(use)), scaled[use, -1] * sd[-1]) / sd[use]
                    out.append((*[b[k].iloc[r] for k in keys], b["__b"].iloc[r], int(n[r, -1, -1]), arm, float(mean[-1]), [features[c] for c in chosen], mean[:-1].tolist(), weight.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "fit", "n_train", "arm", "level", "selected", "mean", "weight"])

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["fit long, n_train long, arm string, level double, selected array<string>, mean array<double>, weight array<double>"])
    return summed.mapInPandas(solve, schema)


def rescreened_walk_forward(df: DataFrame, keys: list[str], order: str, level: str, baselines: list[str], candidates: list[str], horizon: int = 6, least: int = 300, every: int = 20, window: int = 260, most: int = 20, floor: float = 0.03, coverage: float = 0.9, rho: float = 0.7, penalty: float = 15.0, fit_at: int | None = None) -> DataFrame:
    """(keys, order, place, arm, fit, fitted_at, n_train, selected, y, prediction): the level's change over ``horizon`` sessions, by two models.

    The first fit is at the session that knows ``least`` labels, then every ``every`` sessions; each trains on all labels known by
    then and screens the candidates on the labels that became known in the last ``window`` sessions (whole blocks of ``every``):
    by |correlation| with the label, at least ``floor``, present in ``coverage`` of the rows, and under ``rho`` to any better one.
    With ``fit_at`` there is one fit, at that place, screened on all it knows and tried on later sessions alone. The prediction
    is null where the level or a baseline is, or under ``coverage`` of the selected candidates are there; both arms alike.
    Keys with too few labels have no rows. Nothing later than a session is seen there.
    """
    if window % every:
        raise ValueError("the window must be whole blocks")
    features = [*baselines, *candidates]
    rows = placed(df, keys, order, features, level, horizon, least, every, fit_at)
    models = refits(rows, keys, baselines, candidates, window, every, most, floor, coverage, rho, penalty)
    at = rows.where(F.col("__fit") >= 0).join(models.withColumnRenamed("fit", "__fit"), [*keys, "__fit"])
    value = F.array(*[F.col(f) for f in features])
    terms = F.zip_with(F.zip_with(value, "mean", lambda v, m: F.coalesce(v - m, F.lit(0.0))), "weight", lambda a, b: a * b)
    score = F.col("level") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    there = [F.when(F.array_contains("selected", c) & F.col(c).isNotNull(), 1).otherwise(0) for c in candidates]
    share = sum(there, F.lit(0)) / F.nullif(F.size("selected"), F.lit(0))
    whole = F.col("__level").isNotNull() & (F.coalesce(share, F.lit(1.0)) >= coverage)
    for f in baselines:
        whole = whole & F.col(f).isNotNull()
    fitted = F.col("__first") + F.col("__fit") * F.lit(every)
    return at.select(*keys, order, F.col("__i").alias("place"), "arm", F.col("__fit").alias("fit"), fitted.alias("fitted_at"), "n_train", "selected", F.col("__y").alias("y"), F.when(whole, score).alias("prediction"))
