"""The window screener against plain loops on 200 series with gaps, ties and near copies."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import screener


def rho(a, b, least=60):
    ok = ~(np.isnan(a) | np.isnan(b))
    if ok.sum() < least:
        return None
    a, b = (pd.Series(v[ok]).rank().to_numpy() for v in (a, b))
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else None


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(7)
    n, items = 240, 200
    base = rng.normal(size=(40, n))
    x = np.stack([np.round(base[i % 40] + rng.choice([0.2, 0.6, 3.0]) * rng.normal(size=n), 1) for i in range(items)])
    x[rng.random(x.shape) < rng.choice([0, 0.1, 0.5], size=(items, 1))] = np.nan
    x[3], x[7, 50:] = 2.5, np.nan
    year = 2020 + np.arange(n) // 80
    y = np.round(0.4 * base[:20].mean(0) * 4 + rng.normal(size=n), 2)
    level = np.round(base[30] * 2 + rng.normal(size=n) / 9, 2)
    rows = [(w, f"i{i:03d}", f"g{i % 3}", s, int(year[s]), None if np.isnan(x[i, s]) else float(x[i, s]), float(y[s]), float(level[s])) for i in range(items) for s in range(n) for w in (("a", "b") if s >= 60 else ("a",))]
    return spark.createDataFrame(rows, "w string, item string, grp string, s long, year int, x double, y double, level double").repartition(8), x, y, level, year


def test_pairs(made):
    rows, x, *_ = made
    want = {(f"i{a:03d}", f"i{b:03d}"): r for a in range(200) for b in range(a + 1, 200) if (r := rho(x[a], x[b])) is not None and abs(r) >= 0.7}
    for block in (16, 500):
        got = {(r["a"], r["b"]): r["rho"] for r in screener.correlated_pairs(rows.where("w = 'a'"), ["w"], "item", block=block).collect()}
        assert got == pytest.approx(want, abs=1e-12) and len(want) > 50


def test_screen_against_loops(made):
    rows, x, y, level, year = made
    got = {(r["w"], r["item"]): r for r in screener.screen_window(rows, ["w"], "item", "grp", min_cov=0.6, min_same=0.6).collect()}
    assert len(got) == 400
    for w, at in (("a", slice(0, None)), ("b", slice(60, None))):
        figures = {}
        a, yy, lv, yr = x[:, at], y[at], level[at], year[at]
        for i in range(200):
            blocks = [k for k in range(0, len(yy) - 19, 20)]
            rs = []
            for k in blocks:
                u, v = a[i, k : k + 20], yy[k : k + 20]
                ok = ~np.isnan(u)
                rs.append(np.corrcoef(u[ok], v[ok])[0, 1] if ok.sum() >= 10 and u[ok].std() > 0 else np.nan)
            rs = np.array(rs)[~np.isnan(rs)]
            ic = rho(a[i], yy)
            years = [rho(a[i][yr == t], yy[yr == t]) for t in sorted(set(yr)) if (yr == t).sum() >= 30]
            good = [r for r in years if r is not None]
            same = sum(np.sign(r) == np.sign(ic or 0) for r in good) / len(good) if len(years) >= 3 and len(good) >= 3 else None
            icir = rs.mean() / rs.std(ddof=1) if len(blocks) >= 6 and len(rs) > 1 and rs.std(ddof=1) > 1e-12 else None
            figures[i] = (ic, icir, rho(a[i], lv), same, (~np.isnan(a[i])).mean())
        alive = {i for i, (ic, icir, mech, same, cov) in figures.items() if ic is not None and icir is not None and not (mech is not None and abs(mech) >= 0.7) and cov >= 0.6 and not (same is not None and same < 0.6)}
        passed = set()
        for g in range(3):
            own = [i for i in alive if i % 3 == g]
            if len(own) >= 4:
                t = [np.percentile([abs(figures[i][k]) for i in own], 50) for k in (0, 1)]
                passed |= {i for i in own if abs(figures[i][0]) >= t[0] - 1e-9 and abs(figures[i][1]) >= t[1] - 1e-9}
        kept = []
        for i in sorted(passed, key=lambda i: (-round(abs(figures[i][1]), 9), i)):
            if not any(abs(rho(a[i], a[k]) or 0) >= 0.7 for k in kept):
                kept.append(i)
        for i, f in figures.items():
            r = got[w, f"i{i:03d}"]
            for name, v in zip(("ic", "icir", "mech", "same", "cov"), f, strict=True):
                assert r[name] == (None if v is None else pytest.approx(v, abs=1e-8)), (w, i, name)
            assert (r["alive"], r["passed"], r["kept"]) == (i in alive, i in passed, i in kept), (w, i)
        assert 0 < len(kept) < len(passed)


def test_chains_and_no_rows(spark):
    items = spark.createDataFrame([("w", k, k) for k in range(12)] + [("v", 3, 1)], "w string, item int, place int")
    pairs = spark.createDataFrame([("w", k, k + 1) for k in range(6)] + [("w", 8, 7)], "w string, a int, b int")
    got = {(r["w"], r["item"]): r["kept"] for r in screener.independent_set(items, pairs, ["w"], "item").collect()}
    assert got == {("w", k): k not in (1, 3, 5, 8) for k in range(12)} | {("v", 3): True}
    none = spark.createDataFrame([], "w string, item string, grp string, s long, year int, x double, y double, level double")
    assert screener.screen_window(none, ["w"], "item", "grp").count() == 0
