"""The re-screening walk-forward against fits from the rows themselves, session by session."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import rescreen as W

N, H, LEAST, EVERY, WINDOW = 320, 6, 90, 20, 80
BASE, CAND = ["a", "b"], ["c", "d", "e", "f"]
RULES = dict(most=2, floor=0.03, coverage=0.9, rho=0.7, penalty=15.0)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((N, 6))
    x[:, 3] = x[:, 2] + 0.2 * rng.standard_normal(N)  # d is nearly c
    level = np.cumsum(0.3 * x[:, 4] + rng.standard_normal(N)) + 100
    x[rng.random(N) < 0.05, 2] = np.nan
    x[200:, 5] = np.where(rng.random(120) < 0.5, np.nan, x[200:, 5])  # f is seldom there later on
    x[150, 0] = x[151, 1] = np.nan
    level[[40, 160, 161]] = np.nan
    return x, level


def frame(spark, x, level, until=N):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(k, 5 + i, none(level[i]), *map(none, x[i])) for k in (1, 2) for i in range(until)]
    return spark.createDataFrame(rows, "k int, s long, level double, a double, b double, c double, d double, e double, f double").repartition(4)


def run(spark, df, **more):
    return W.rescreened_walk_forward(df, ["k"], "s", "level", BASE, CAND, H, LEAST, EVERY, WINDOW, **RULES, **more)


def corr(a, b):
    ok = ~np.isnan(a) & ~np.isnan(b)
    return np.corrcoef(a[ok], b[ok])[0, 1] if ok.sum() > 1 and a[ok].std() > 0 and b[ok].std() > 0 else np.nan


def by_rows(x, level, fit_at=None):
    """(place, arm) -> (fitted_at, n_train, selected, prediction), every fit anew from the rows."""
    y = np.r_[level[H:] - level[:-H], np.full(H, np.nan)]
    labels = np.flatnonzero(~np.isnan(y))
    first = labels[LEAST - 1] + H if fit_at is None else fit_at
    out = {}
    for t in range(first if fit_at is None else first + 1, N):
        at = first + (t - first) // EVERY * EVERY if fit_at is None else first
        train = labels[labels + H <= at]
        recent = train[train + H > at - WINDOW] if fit_at is None else train
        score = {c: corr(x[recent, c], y[recent]) for c in range(2, 6)}
        fine = [c for c in score if abs(score[c]) >= 0.03 and (~np.isnan(x[recent, c])).mean() >= 0.9]
        taken = []
        for c in sorted(fine, key=lambda c: -abs(score[c])):
            if len(taken) < 2 and all(abs(corr(x[recent, c], np.where(np.isnan(x[recent, o]), np.nan, x[recent, o]))) < 0.7 for o in taken):
                taken.append(c)
        fits = not (np.isnan(level[t]) or np.isnan(x[t, :2]).any() or (taken and (~np.isnan(x[t, taken])).mean() < 0.9))
        for arm, use in (("baseline", [0, 1]), ("full", [0, 1, *taken])):
            m, sd = np.nanmean(x[train][:, use], axis=0), np.nanstd(x[train][:, use], axis=0)
            z = np.nan_to_num((x[train][:, use] - m) / sd)
            w = np.linalg.solve(z.T @ z + 15 * np.eye(len(use)), z.T @ (y[train] - y[train].mean()))
            now = y[train].mean() + np.nan_to_num((x[t, use] - m) / sd) @ w
            out[t, arm] = at, len(train), [(BASE + CAND)[c] for c in taken], now if fits else np.nan
    return out


@pytest.mark.parametrize("fit_at", [None, 180])
def test_equal_to_fits_from_rows(spark, data, fit_at):
    got = run(spark, frame(spark, *data), fit_at=fit_at).toPandas()
    want = by_rows(*data, fit_at)
    assert len(got) == 2 * len(want) and (got["s"] == got["place"] + 5).all()
    for r in got.itertuples():
        fitted, n, selected, prediction = want[r.place, r.arm]
        assert (r.fitted_at, r.n_train, list(r.selected)) == (fitted, n, selected)
        assert np.isclose(r.prediction, prediction, rtol=1e-8, equal_nan=True)
    assert got["prediction"].isna().sum() > 0 and (fit_at is not None or got["selected"].map(tuple).nunique() > 1)


def test_nothing_later_is_seen(spark, data):
    x, level = data
    later = np.where(np.arange(N) >= 250, level + 999, level)
    moved = np.where(np.arange(N)[:, None] >= 250, -x, x)
    whole, part, other = (run(spark, df).where("place < 250").toPandas().sort_values(["k", "place", "arm"]).reset_index(drop=True) for df in (frame(spark, x, level), frame(spark, x, level, 250), frame(spark, moved, later)))
    cols = ["k", "place", "arm", "fitted_at", "n_train", "prediction"]
    pd.testing.assert_frame_equal(whole[cols], part[cols])
    pd.testing.assert_frame_equal(whole[cols], other[cols])


def test_odd_tables(spark, data):
    df = frame(spark, *data)
    assert run(spark, df.where("false")).count() == 0
    assert run(spark, df.where("s < 60")).count() == 0  # too few labels
    bare = df.selectExpr("k", "s", "level", "a", "b", *[f"cast(null as double) as {c}" for c in CAND])
    got = run(spark, bare).toPandas()  # no candidate has a value: none is selected, both arms agree
    both = got.pivot_table(index=["k", "place"], columns="arm", values="prediction")
    assert (got["selected"].map(len) == 0).all() and len(both) and np.allclose(both["baseline"], both["full"])
    with pytest.raises(ValueError):
        W.rescreened_walk_forward(df, ["k"], "s", "level", BASE, CAND, window=250, every=20)
