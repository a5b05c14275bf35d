"""Trees against a plain recursive search, and the purged holdout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def plain(x, y, depth, leaf, node=1):
    """All thresholds of all features tried one by one."""
    out = {node: (len(y), y.mean(), None, None)}
    if depth == 0:
        return out
    best, total = None, ((y - y.mean()) ** 2).sum()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            left = x[:, f] <= a
            if min(left.sum(), (~left).sum()) >= leaf:
                rest = sum(((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left))
                gain = round((total - rest) / total, 10) if total else 0
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, f, (float(a) + float(b)) / 2, left)
    if best is None:
        return out
    out[node] = (len(y), y.mean(), best[1], best[2])
    for side, m in enumerate((best[3], ~best[3])):
        out |= plain(x[m], y[m], depth - 1, leaf, 2 * node + side)
    return out


def sent(x, tree, depth):
    out = []
    for row in x:
        node = 1
        while tree[node][2] is not None and node < 2**depth:
            node = 2 * node + (row[tree[node][2]] > tree[node][3])
        out.append(tree[node][1])
    return np.array(out)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    data, rows = {}, []
    for k in ("a", "b", None):
        n = 420
        x = np.round(rng.normal(size=(n, 3)), 1).astype(np.float32)
        x[:, 2] = x[:, 1]  # equal splits: the first feature counts
        y = np.round(np.where(x[:, 0] > 0.3, 2.0, -1.0) * (1 + (x[:, 1] > 0)) + rng.normal(size=n), 2)
        data[k] = (x, y)
        rows += [(k, s, *map(float, x[s]), float(y[s])) for s in range(n)]
    rows += [("a", 1000, None, 1.0, 1.0, 5.0), ("b", 1000, 1.0, 1.0, 1.0, None), ("one", 0, 1.0, 2.0, 3.0, 4.0)]
    return spark.createDataFrame(rows, "k string, s long, u double, v double, w double, y double").repartition(4), data


NAMES = ["u", "v", "w"]


def table(nodes, k):
    return {r["node"]: (r["n"], r["value"], r["feature"], r["threshold"]) for r in nodes.collect() if r["k"] == k}


@pytest.mark.parametrize("depth", [2, 3])
def test_nodes_and_inference(made, depth):
    rows, data = made
    nodes = trees.grow(rows, ["k"], NAMES, "y", depth, leaf=40)
    assert table(nodes, "one") == {1: (1, 4.0, None, None)}
    got = {(r["k"], r["s"]): r["pred"] for r in trees.predict(rows, nodes, ["k"], NAMES, depth).collect()}
    for k, (x, y) in data.items():
        want = plain(x, y, depth, 40)
        own = table(nodes, k)
        assert own.keys() == want.keys()
        for node, w in want.items():
            assert own[node][0] == w[0] and own[node][2] == w[2] and own[node][1] == pytest.approx(w[1]) and (w[3] is None or own[node][3] == pytest.approx(w[3]))
        assert [got[k, s] for s in range(len(y))] == pytest.approx(sent(x, want, depth).tolist())
    assert got["a", 1000] is None


def test_many_nodes_are_joined_by_a_shuffle(made, monkeypatch):
    rows, _ = made
    want = sorted(map(str, trees.grow(rows, ["k"], NAMES, "y", 2).collect()))
    monkeypatch.setattr(trees, "BROADCAST_NODES", 0)
    assert sorted(map(str, trees.grow(rows, ["k"], NAMES, "y", 2).collect())) == want


def test_quantile_bins_come_near(spark):
    rng = np.random.default_rng(2)
    x = rng.random(4000).astype(np.float32)
    rows = spark.createDataFrame([(1, float(v), 1.0 if v > 0.37 else 0.0) for v in x], "k int, x double, y double").withColumnRenamed("x", "f")
    root = table(trees.grow(rows, ["k"], ["f"], "y", 1, bins=64), 1)[1]
    assert root[2] == 0 and abs(root[3] - 0.37) < 1 / 32


def test_holdout_purges_labels_that_cross(spark):
    rows = spark.range(406).selectExpr("1 as k", "id as s").union(spark.range(299).selectExpr("2 as k", "id as s"))
    parts = trees.chronological(rows, ["k"], "s", 6)
    got = {(r["k"], r["part"]): (r["n"], r["last"]) for r in parts.groupBy("k", "part").agg(F.count("s").alias("n"), F.max("s").alias("last")).collect()}
    assert got == {(1, "fit"): (318, 317), (1, "purged"): (6, 323), (1, "validation"): (82, 405), (2, None): (299, 298)}


def test_depth_is_chosen_on_the_holdout_and_the_future_changes_nothing(made):
    rows, data = made
    known = rows.where("k is not null and k <> 'one' and s < 406")
    errors = {(r["k"], r["depth"]): r for r in trees.depth_errors(trees.chronological(known, ["k"], "s", 6), ["k"], NAMES, "y").collect()}
    for k in ("a", "b"):
        x, y = (v[:406] for v in data[k])
        tree = plain(x[:318], y[:318], 3, 40)
        rmse = {d: float(np.sqrt(((sent(x[324:], tree, d) - y[324:]) ** 2).mean())) for d in (2, 3)}
        best = min(rmse, key=lambda d: (round(rmse[d], 10), d))
        for d in (2, 3):
            assert errors[k, d]["rmse"] == pytest.approx(rmse[d]) and errors[k, d]["chosen"] == (d == best)
        full = plain(x, y, best, 40)
        own = table(trees.chosen_tree(known, ["k"], NAMES, "y", "s", 6), k)
        assert own.keys() == full.keys() and all(own[n][2] == full[n][2] for n in full)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, u double, y double")
    assert trees.grow(none, ["k"], ["u"], "y", 2).count() == 0
