"""The discounted linear model against a filter that carries mean and covariance on row by row."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import discounted as D

START, DELAY, PENALTY = 120, 6, 15.0
DISCOUNTS, SPREADS = [1.0, 0.995, 0.98], [1.0, 6.0, 18.0]


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(7)
    out = {}
    for k in (1, 2):
        x = rng.standard_normal((260, 2))
        y = x @ [0.5 * k, -0.2] + 0.3 + rng.standard_normal(260)
        x[rng.random(260) < 0.08 * (k - 1), 0] = np.nan
        y[rng.random(260) < 0.1 * (k - 1)] = np.nan
        y[-DELAY:] = np.nan
        out[k] = x, y
    return out


def frame(spark, walks, until=260):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(k, 10 + i, none(x[i, 0]), none(x[i, 1]), none(y[i])) for k, (x, y) in walks.items() for i in range(min(until, len(y)))]
    return spark.createDataFrame(rows, "k int, s long, a double, b double, y double").repartition(5)


def by_row(x, y, discount, spread):
    """place -> (mean, sd, taken), by the textbook recursion."""
    good = ~np.isnan(y) & ~np.isnan(x).any(axis=1)
    train = [i for i in range(START - DELAY) if good[i]]
    d = np.column_stack([np.ones(len(train)), x[train]])
    w = np.linalg.solve(x[train].T @ x[train] + PENALTY * np.eye(2), x[train].T @ (y[train] - y[train].mean()))
    m = np.r_[y[train].mean(), w]
    noise = max(np.mean((y[train] - d @ m) ** 2), 1e-6)
    p = spread * noise * np.linalg.inv(d.T @ d + np.diag([0, PENALTY, PENALTY]))
    clock = last = train[-1]
    out = {}
    for t in range(START, len(y)):
        o = t - DELAY
        take = o - last >= DELAY and good[o]
        if take:
            h = np.r_[1, x[o]]
            p = p * discount ** (clock - o)
            q = h @ p @ h + noise
            m, p = m + p @ h * (y[o] - h @ m) / q, p - np.outer(p @ h, h @ p) / q
            clock = last = o
        h = np.r_[1, x[t]]
        out[t] = h @ m, np.sqrt(noise + h @ p @ h * discount ** (clock - t)), take
    return out


def grid(spark, df):
    return D.filter_grid(df, ["k"], "s", ["a", "b"], "y", START, DISCOUNTS, SPREADS, DELAY, PENALTY)


def test_each_pair_is_the_single_filter(spark, walks):
    got = grid(spark, frame(spark, walks)).toPandas()
    assert len(got) == 2 * 9 * (260 - START) and (got["s"] == got["place"] + 10).all()
    for (k, discount, spread), rows in got.groupby(["k", "discount", "spread"]):
        want = by_row(*walks[k], discount, spread)
        rows = rows.set_index("place").sort_index()
        for i, name in enumerate(("mean", "sd")):
            assert np.allclose(rows[name], [want[t][i] for t in rows.index], rtol=1e-8, atol=1e-8, equal_nan=True)
        assert rows["updated"].tolist() == [want[t][2] for t in rows.index]


def test_spread_controls_the_gain_and_nothing_later_is_seen(spark, walks):
    whole = grid(spark, frame(spark, walks)).toPandas()
    part = grid(spark, frame(spark, walks, 200)).toPandas()
    changed = {k: (x, np.where(np.arange(260) >= 200 - DELAY, y - 9999, y)) for k, (x, y) in walks.items()}
    other = grid(spark, frame(spark, changed)).where("place < 200").toPandas()
    on = ["k", "discount", "spread", "place"]
    for again in (part, other):
        both = again.merge(whole, on=on, suffixes=("", "_w"))
        assert len(both) == len(again) == 2 * 9 * 80
        assert np.allclose(both["mean"], both["mean_w"], rtol=1e-9, equal_nan=True) and np.allclose(both["sd"], both["sd_w"], rtol=1e-9, equal_nan=True)
    sd = whole[whole["place"] == START].pivot_table(index=["k", "discount"], columns="spread", values="sd")
    assert (sd[1.0] < sd[6.0]).all() and (sd[6.0] < sd[18.0]).all()


def test_choice_by_validation_alone_and_ties(spark, walks):
    made = grid(spark, frame(spark, walks))
    errors = D.grid_errors(made, ["k"], 200, DELAY).toPandas()
    assert len(errors) == 18 and (errors.groupby("k")["chosen"].sum() == 1).all()
    rows = made.toPandas()
    rows = rows[(rows["place"] + DELAY < 200) & rows["y"].notna() & rows["mean"].notna()]
    want = rows.assign(e=(rows["mean"] - rows["y"]) ** 2).groupby(["k", "discount", "spread"])["e"].mean().pow(0.5)
    assert np.allclose(errors.set_index(["k", "discount", "spread"])["rmse"].sort_index(), want.sort_index())
    assert errors[errors["chosen"]].set_index("k")["rmse"].to_dict() == errors.groupby("k")["rmse"].min().to_dict()
    changed = {k: (x, np.where(np.arange(260) >= 200, y - 9999, y)) for k, (x, y) in walks.items()}
    again = D.grid_errors(grid(spark, frame(spark, changed)), ["k"], 200, DELAY).toPandas()
    pd.testing.assert_frame_equal(*(e.sort_values(["k", "discount", "spread"]).reset_index(drop=True) for e in (errors, again)))
    even = spark.createDataFrame([(1, p, 0.0, d, c, 1.0) for p in range(5) for d in DISCOUNTS for c in SPREADS], "k int, place long, y double, discount double, spread double, mean double")
    tied = D.grid_errors(even, ["k"], 20, DELAY).where("chosen").toPandas()
    assert tied[["discount", "spread"]].values.tolist() == [[1.0, 1.0]]
    out = D.chosen_forecasts(made, D.grid_errors(made, ["k"], 200, DELAY), ["k"], 200).toPandas()
    assert len(out) == 2 * 60 and ((out["up"] > 0.5) == (out["mean"] > 0))[out["mean"].notna()].all()


def test_odd_tables(spark, walks):
    df = frame(spark, walks)
    assert grid(spark, df.where("false")).count() == 0
    assert grid(spark, df.where("s < 60")).count() == 0  # no session from the start on
    bare = df.selectExpr("k", "s", "a", "b", "cast(null as double) as y")
    assert grid(spark, bare).count() == 0  # nothing to fit
    for discounts, spreads in (([1.1], [1.0]), ([0.0], [1.0]), ([1.0], [0.0])):
        with pytest.raises(ValueError):
            D.filter_grid(df, ["k"], "s", ["a", "b"], "y", START, discounts, spreads)
