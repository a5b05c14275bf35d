"""Models, simulators and sinks against plain numpy, or by their properties."""

import numpy as np
import pytest

from tidemark.operators import ingest, models
from tidemark.operators.simulate import simulate_path


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(48)
    n = 420
    level = 200 + rng.standard_normal(n).cumsum()
    x = rng.standard_normal((n, 3))
    x[5:9, 1] = np.nan
    x[400, :2] = np.nan
    return level, x


def frame(spark, level, x):
    rows = [(1, i, float(v), *[None if np.isnan(c) else float(c) for c in r]) for i, (v, r) in enumerate(zip(level, x, strict=True))]
    return spark.createDataFrame(rows, "k int, s long, level double, a double, b double, c double").repartition(3)


def test_walk_forward(spark, walk):
    level, x = walk
    got = models.walk_forward(frame(spark, level, x), ["a", "b", "c"], "level", ["k"], penalty=15.0).toPandas().sort_values("s").set_index("s")
    assert got["prediction"].first_valid_index() == 305 and got.loc[400, "skipped"] and np.isnan(got.loc[400, "prediction"])
    y = np.append(level[6:] - level[:-6], np.full(6, np.nan))
    for t, fit in ((305, 305), (324, 305), (325, 325), (419, 405)):
        train = np.arange(fit - 6 + 1)
        own = x[train]
        filled = np.where(np.isnan(own), np.nanmedian(own, axis=0), own)
        low, high = np.quantile(filled, [0.01, 0.99], axis=0)
        cut = np.clip(filled, low, high)
        z = (cut - cut.mean(axis=0)) / cut.std(axis=0)
        w = np.linalg.solve(z.T @ z + 15 * np.eye(3), z.T @ (y[train] - y[train].mean()))
        now = (np.clip(x[t], low, high) - cut.mean(axis=0)) / cut.std(axis=0)
        assert got.loc[t, "fitted_at"] == fit and got.loc[t, "n_train"] == len(train)
        assert np.isclose(got.loc[t, "prediction"], y[train].mean() + now @ w)
    later = level.copy()
    later[390:] += 50
    again = models.walk_forward(frame(spark, later, x), ["a", "b", "c"], "level", ["k"]).toPandas().sort_values("s").set_index("s")
    assert np.allclose(got["prediction"][:390], again["prediction"][:390], equal_nan=True)


def test_block_bootstrap(spark):
    rows = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(80)], "i long, x double, one double")
    drawn = models.block_starts(rows, 80, 50).toPandas().sort_values(["draw", "i"])
    assert (drawn.groupby("draw").size() == 80).all() and drawn["at"].between(0, 79).all()
    steps = drawn.assign(step=drawn.groupby("draw")["at"].diff(), place=drawn["i"] % 12)
    assert (steps["step"][steps["place"] > 0] == 1).all()
    got = {r["name"]: r for r in models.bootstrap_intervals(rows, ["x", "one"], 80, draws=200).collect()}
    assert got["one"]["low"] == got["one"]["high"] == 1.0 and got["x"]["low"] < 3 < got["x"]["high"]
    with pytest.raises(ValueError):
        models.block_starts(rows, 5, 10)


def test_last_session_only_plans():
    level = [0, 1, 2, 3]
    out = simulate_path(level, [1, 1, -1, -1], hold=6, reverse=True)
    assert [p for p, *_ in out] == [0, 1, 1, -1] and out[2][3] == "reverse"
    out = simulate_path(level[:3], [1, 1, -1], hold=6, reverse=True)
    assert [p for p, *_ in out] == [0, 1, 1] and all(r == "" for *_, r in out) and out[-1][2] == 2
    with pytest.raises(ValueError):
        simulate_path([10, None, 9, 6], [1, 1, 1, 1])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024"), (2, None, "2024"), (3, 'x"y', "2025")], "i int, t string, at string")
    path = str(tmp_path / "table")
    assert ingest.write_if_changed(rows, path, ["at"]) and not ingest.write_if_changed(rows.repartition(3), path, ["at"])
    assert not ingest.write_if_changed(rows.withColumn("at", models.F.lit("2026")), path, ["at"])
    assert ingest.write_if_changed(rows.where("i < 3"), path, ["at"]) and spark.read.parquet(path).count() == 2
    assert ingest.append_new(rows, path, "i") == 1 and ingest.append_new(rows, path, "i") == 0 and spark.read.parquet(path).count() == 3
    index = {r["at"]: r["rows"] for r in ingest.write_shards(rows, str(tmp_path / "shards"), ["at"]).collect()}
    assert index == {"2024": 2, "2025": 1} and spark.read.json(str(tmp_path / "shards")).count() == 3
    ingest.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["t"] for r in back.collect()} == {"a", None, 'x"y'}
