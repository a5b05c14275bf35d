"""The checkup grid against plain numpy on small tests with fractions, ties and gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checkup, stats


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def corr(a, b):
    return float(np.corrcoef(a, b)[0, 1])


def slope_t(x, y, lag):
    a = x - x.mean()
    beta = (a * (y - y.mean())).sum() / (a * a).sum()
    u = a * (y - y.mean() - beta * a)
    v = (u * u).sum() + 2 * sum((1 - k / (lag + 1)) * (u[k:] * u[:-k]).sum() for k in range(1, lag + 1))
    return beta * (a * a).sum() / np.sqrt(v)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k, h in ((0, 1), (1, 5), (2, 40), (3, 1), (4, 5)):
        n = 150 if k == 3 else 260
        x = np.round(rng.normal(size=n), 1) / 100 + 1.7
        y = np.round(0.3 * (x - 1.7) + rng.normal(size=n) / 200, 4)
        z = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n) * 1.2)
        if k == 4:
            x[:] = 1.625
        want[k] = (h, x, y, z)
        rows += [(k, h, int(3 * s), float(x[s]), float(y[s]), None if np.isnan(z[s]) else float(z[s])) for s in range(n)]
    return spark.createDataFrame(rows, "k int, h int, s long, x double, y double, z double").repartition(4), want


def test_figures(made):
    tests, want = made
    got = {r["k"]: r for r in checkup.checkup(tests, ["k", "h"], "h", (1, 5, 40), 300).collect()}
    assert set(got) == {0, 1, 2, 4}
    flat = got[4]
    assert flat["n"] == 260 and all(flat[c] is None for c in ("ic", "icp", "icir", "t", "ti", "pind", "p", "kurt", "acf"))
    for k in (0, 1, 2):
        h, x, y, z = want[k]
        r, n = got[k], len(x)
        a = x - x.mean()
        expect = {"ic": corr(ranks(x), ranks(y)), "icp": corr(x, y), "acf": (a[1:] * a[:-1]).sum() / (a * a).sum(), "kurt": (a**4).mean() / (a * a).mean() ** 2 - 3}
        rolled = np.array([corr(x[e - 59 : e + 1], y[e - 59 : e + 1]) for e in range(59, n)])
        expect["icir"] = rolled.mean() / rolled.std(ddof=1)
        expect["t"] = slope_t(x, y, max(h - 1, int(4 * (n / 100) ** (2 / 9))))
        turns = [abs(corr(ranks(x), np.roll(ranks(y), s))) for s in range(n)]
        expect["p"] = np.mean(np.array(turns) >= turns[0] - 1e-12)
        pos = np.where(z > 1, 1, np.where(z < -1, -1, 0))
        expect["turn"] = (np.diff(pos) != 0).mean()
        gain = (pos * y)[pos != 0]
        expect["win"], expect["pl"] = (gain > 0).mean(), gain[gain > 0].mean() / -gain[gain < 0].mean()
        expect["q5"], expect["q1"] = y[z > 0.8416].mean(), y[z <= -0.8416].mean()
        expect["qd"] = expect["q5"] - expect["q1"]
        for name, v in expect.items():
            assert r[name] == pytest.approx(v, rel=1e-7, abs=1e-9), (k, name)
        assert r["m"] == len(x[::h]) and (r["ti"] is None) == (r["m"] < 15) and (r["pind"] is None) == (r["ti"] is None)


def test_student_p(spark):
    known = [(2.0, 10, 0.07338803), (2.0, 9, 0.07655282), (1.0, 1, 0.5), (2.0, 2, 0.18350342), (0.0, 7, 1.0), (12.706, 1, 0.05), (1.962, 1000, 0.05003), (None, 5, None), (1.0, 0, None)]
    got = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(known)], "i int, t double, d long").select("i", stats.student_p(F.col("t"), F.col("d")).alias("p")).orderBy("i").collect()
    for r, (_, _, p) in zip(got, known, strict=True):
        assert r["p"] is None if p is None else r["p"] == pytest.approx(p, abs=2e-5)


def test_slices_and_marks(spark, made):
    tests, want = made
    part = {"half": F.when(F.col("s") < 390, "a").otherwise("b"), "odd": F.when(F.col("s") % 2 == 1, "o")}
    got = {(r["k"], r["slice"]): r for r in checkup.checkup_slices(tests, ["k", "h"], part).collect()}
    _, x, y, _ = want[0]
    assert got[0, "half:a"]["n"] == 130 and got[0, "half:a"]["ic"] == pytest.approx(corr(ranks(x[:130]), ranks(y[:130])))
    assert got[0, "odd:o"]["ic"] == pytest.approx(corr(ranks(x[1::2]), ranks(y[1::2])))
    assert got[0, "recent:"]["ic"] == pytest.approx(corr(ranks(x[-125:]), ranks(y[-125:])))
    assert got[3, "half:b"]["n"] == 20 and got[3, "half:b"]["ic"] is None and got[4, "half:a"]["ic"] is None
    ps = [(0.01, "g"), (0.02, "g"), (0.3, "g"), (None, "g"), (0.04, "h")]
    frame = spark.createDataFrame([(1, g, p, p) for p, g in ps], "b int, g string, pind double, p double")
    assert sorted((r["g"], r["pind"] or 9, r["sig"], r["sigp"]) for r in checkup.marked(frame, ["b"], "g").collect()) == [("g", 0.01, True, True), ("g", 0.02, True, True), ("g", 0.3, False, False), ("g", 9, False, False), ("h", 0.04, True, True)]


def test_turns_of_fractions(spark):
    rows = [("a", s, 1.6 + (s * 7 % 11) / 100, 1.8 + (s * 5 % 13) / 1000) for s in range(80)] + [("flat", s, 1.5, float(s)) for s in range(9)]
    got = {r["k"]: r for r in stats.circular_shift_test(spark.createDataFrame(rows, "k string, s int, x double, y double"), "x", "y", ["k"]).collect()}
    x, y = (np.array([r[c] for r in rows[:80]]) for c in (2, 3))
    turns = [abs(corr(x, np.roll(y, s))) for s in range(80)]
    assert got["a"]["ic"] == pytest.approx(corr(x, y)) and got["a"]["shifts"] == 79 and got["a"]["p"] == np.mean(np.array(turns) >= turns[0] - 1e-12)
    assert got["flat"]["ic"] is None and got["flat"]["p"] is None
