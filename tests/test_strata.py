"""Boundaries, classes and shared block draws against plain numpy."""

import numpy as np
import pytest

from tidemark.operators import strata as S

N, DRAWS, BLOCK = 101, 60, 12


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    y = rng.standard_normal(N).round(2)
    y[[3, 50]] = 0
    y[[20, 21, 100]] = np.nan
    p = {m: (0.5 * np.nan_to_num(y) + rng.standard_normal(N)).round(3) for m in ("ridge", "tree")}
    p["same"] = p["ridge"].copy()
    return p, y


def frame(spark, data):
    p, y = data
    rows = [(m, 3 * i, float(v[i]), None if np.isnan(y[i]) else float(y[i])) for m, v in p.items() for i in range(N)]
    return spark.createDataFrame(rows, "model string, s long, p double, y double").repartition(5)


def index(spark):
    """Each draw's places, from its starts."""
    at = S.starts(spark, N, DRAWS, BLOCK).toPandas().sort_values(["draw", "b"])
    return np.stack([(g["start"].to_numpy()[:, None] + np.arange(BLOCK)).ravel()[:N] for _, g in at.groupby("draw")])


def test_boundaries_and_classes(spark, data):
    df = frame(spark, data)
    bounds = S.boundaries(df, ["model"], "p")
    got = {(r["model"], r["side"]): r for r in bounds.collect()}
    codes = {(r["model"], r["s"] // 3): r["code"] for r in S.classify(df, bounds, ["model"], "p").collect()}
    for m, v in data[0].items():
        for side in (1, -1):
            own = np.abs(v[v * side > 0])
            assert got[m, side]["n"] == len(own) and np.allclose(got[m, side]["cuts"], np.quantile(own, [1 / 3, 2 / 3]))
            cuts = got[m, side]["cuts"]
            for i in np.flatnonzero(v * side > 0):
                assert codes[m, i] == side * (1 + np.searchsorted(cuts, abs(v[i]), side="left"))
    few = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0), ("x", 3, -1.0), ("x", 4, 0.0), ("x", 5, None)], "model string, s int, p double")
    b = S.boundaries(few, ["model"], "p")
    assert [r["cuts"] for r in b.collect()] == [None, None]
    assert [r["code"] for r in S.classify(few, b, ["model"], "p").orderBy("s").collect()] == [99, 99, -99, 0, None]


def test_strata_share_draws(spark, data):
    df = frame(spark, data)
    coded = S.classify(df, S.boundaries(df, ["model"], "p"), ["model"], "p")
    drawn = S.strata(coded, ["model"], "s", "y", DRAWS, BLOCK)
    got = {(r["draw"], r["model"], r["code"]): r for r in drawn.collect()}
    codes = {(r["model"], r["s"] // 3): r["code"] for r in coded.collect()}
    ix, y = index(spark), data[1]
    assert ix.shape == (DRAWS, N)
    c = np.array([codes["ridge", i] for i in range(N)])
    for d in range(DRAWS):
        for code in (1, 2, 3, -1, -2, -3):
            own = y[ix[d]][c[ix[d]] == code] * np.sign(code)
            own = own[~np.isnan(own)]
            r = got.get((d, "ridge", code))
            if len(own):
                assert np.isclose(r["signed_mean"], own.mean()) and np.isclose(r["direction_accuracy"], (own > 0).sum() / (own != 0).sum())
            else:
                assert r is None or r["signed_mean"] is None
    apart = {(r["draw"], r["side"]): r["signed_mean"] for r in S.contrasts(drawn, ["model"]).where("model = 'ridge'").collect()}
    assert apart
    for (d, side), v in apart.items():
        if v is not None:
            assert np.isclose(v, got[d, "ridge", 3 * side]["signed_mean"] - got[d, "ridge", side]["signed_mean"])


def test_figures_and_equal_forecasts(spark, data):
    df = frame(spark, data)
    figures = S.forecast_figures(df, "model", "s", "p", "y", DRAWS, BLOCK)
    got = {(r["draw"], r["model"]): r for r in figures.collect()}
    ix, y = index(spark), data[1]
    for d in range(DRAWS):
        for m, v in data[0].items():
            p, t = v[ix[d]], y[ix[d]]
            p, t = p[~np.isnan(t)], t[~np.isnan(t)]
            want = (np.abs(p - t).mean(), np.sqrt(((p - t) ** 2).mean()), (p * t > 0).sum() / (t != 0).sum(), np.corrcoef(p, t)[0, 1])
            assert np.allclose([got[d, m][c] for c in ("mae", "rmse", "direction_accuracy", "ic")], want)
    apart = S.paired(figures, "model", "ridge")
    ends = {(r["model"], r["name"]): r for r in S.intervals(apart, ["model"], ["mae", "rmse", "direction_accuracy", "ic"], DRAWS).collect()}
    assert len(ends) == 8 and all(ends["same", c]["low"] == ends["same", c]["high"] == 0 for c in ("mae", "rmse", "direction_accuracy", "ic"))
    diff = [got[d, "tree"]["mae"] - got[d, "ridge"]["mae"] for d in range(DRAWS)]
    assert np.allclose([ends["tree", "mae"]["low"], ends["tree", "mae"]["high"]], np.quantile(diff, [0.025, 0.975]))


def test_too_little(spark, data):
    df = frame(spark, data)
    for some in (df.where("false"), df.where("s < 15")):
        assert S.forecast_figures(some, "model", "s", "p", "y", DRAWS, BLOCK).count() == 0
        assert S.boundaries(some.where("false"), ["model"], "p").count() == 0
    half = S.forecast_figures(df.withColumn("y", S.F.when(S.F.col("s") < 12, S.F.col("y"))), "model", "s", "p", "y", DRAWS, BLOCK)
    assert all(r["low"] is None for r in S.intervals(half, ["model"], ["mae"], DRAWS).collect())  # most draws have no outcome
