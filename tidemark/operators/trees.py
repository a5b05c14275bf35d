"""Shallow regression trees by histogram sums: every feature of every open node of every model in one aggregate a level."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered

#: Node rows that may be broadcast to the rows they split; more are joined by a shuffle.
BROADCAST_NODES = 100_000


def chronological(df: DataFrame, keys: list[str], order: str, horizon: int, share: float = 0.8, least: int = 300) -> DataFrame:
    """``df`` with ``part``: the last rows of each key are ``validation``, the first ``share`` of them ``fit``, but for those whose label,
    known ``horizon`` sessions later, reaches into the validation: they are ``purged``. Keys under ``least`` rows have no part."""
    w = Window.partitionBy(*keys)
    at = df.withColumns({"__i": F.row_number().over(ordered(keys, order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    split = F.floor(F.col("__n") * share)
    first = F.min(F.when(F.col("__i") >= split, F.col(order))).over(w)
    part = F.when(F.col("__i") >= split, "validation").when(F.col(order) + horizon < first, "fit").otherwise("purged")
    return at.withColumn("part", F.when((F.col("__n") >= least) & (split < F.col("__n")), part)).drop("__i", "__n")


def borders(rows: DataFrame, features: int, most: int = 256) -> list[np.ndarray]:
    """Upper borders of each feature's bins: all its values where there are at most ``most``, else as many quantiles.

    The driver gets ``features`` x ``most`` numbers at most.
    """
    long = rows.select(F.posexplode("x").alias("f", "v"))
    few = F.count_distinct("v") <= most
    sizes = {r["f"]: r["few"] for r in long.groupBy("f").agg(few.alias("few")).collect()}
    whole = [f for f, ok in sizes.items() if ok]
    values = long.where(F.col("f").isin(whole)).groupBy("f").agg(F.collect_set("v").alias("b")) if whole else None
    shares = F.array(*[F.lit((i + 1) / most) for i in range(most)])
    parts = long.where(~F.col("f").isin(whole)).groupBy("f").agg(F.percentile_approx("v", shares, F.lit(100 * most)).alias("b")) if len(whole) < len(sizes) else None
    found = {r["f"]: np.unique(r["b"]) for table in (values, parts) if table is not None for r in table.collect()}
    return [found.get(f, np.zeros(0)) for f in range(features)]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    def bins(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(cuts)))
        return pd.Series(list(np.stack([np.searchsorted(c, m[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.int32)))

    bins.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return rows.withColumn("bins", F.pandas_udf(bins, "array<int>")("x"))


def best_splits(rows: DataFrame, keys: list[str], leaf: int) -> DataFrame:
    """(keys, node, n, value, feature, threshold, gain): of each node's rows (keys, node, y, x, bins) the split that takes most
    of the squared error, with ``leaf`` rows or more on either side; feature null where there is none.

    Sums by feature and bin are added up before the shuffle; what is ordered is a feature's bins. The threshold lies half-way
    between the nearest values. ``gain`` is a share of the node's squared error, in ten digits; of equal gains the first
    feature's lowest threshold counts.
    """
    group = [*keys, "node"]
    long = rows.select(*group, "y", F.posexplode(F.arrays_zip("x", "bins")).alias("f", "p")).select(*group, "y", "f", F.col("p.x").alias("v"), F.col("p.bins").alias("bin"))
    y = F.col("y")
    sums = long.groupBy(*group, "f", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y.cast("double") * y).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = Window.partitionBy(*group, "f")
    by = w.orderBy("bin")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    side = sums.select(*group, "f", "hi", F.lead("lo").over(by).alias("next"), F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).cast("double").alias("sl"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).cast("double").alias("s"), F.sum("q").over(w).alias("q"))
    nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
    base = F.col("s") * F.col("s") / F.col("n")
    taken = F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / F.nullif(nr, F.lit(0)) - base
    gain = F.round(taken / F.nullif(F.col("q") - base, F.lit(0.0)), 10)
    good = F.col("next").isNotNull() & (F.col("nl") >= leaf) & (nr >= leaf) & (gain > 0)
    split = F.struct((-gain).alias("loss"), F.col("f").alias("feature"), ((F.col("hi").cast("double") + F.col("next")) / 2).alias("threshold"))
    best = side.groupBy(*group).agg(F.min(F.when(good, split)).alias("b"), F.first("n").alias("n"), F.min(F.when(F.col("f") == 0, F.col("s") / F.col("n"))).alias("value"))
    return best.select(*group, "n", "value", "b.feature", "b.threshold", (-F.col("b.loss")).alias("gain"))


def _next(node: Column, feature: Column, threshold: Column) -> Column:
    """The child a row goes to: 2 node where its value is at most the threshold, else 2 node + 1; the node itself at a leaf."""
    right = (F.get(F.col("x"), feature) > threshold).cast("int")
    return F.when(feature.isNull(), node).otherwise(2 * node + right)


def _step(rows: DataFrame, nodes: list[tuple], keys: list[str], schema: str) -> DataFrame:
    table = rows.sparkSession.createDataFrame(nodes, schema).select(*[F.col(c).alias(f"__{c}") for c in (*keys, "node")], "feature", "threshold")
    table = F.broadcast(table) if len(nodes) <= BROADCAST_NODES else table
    on = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in (*keys, "node")]
    return rows.join(table, on, "left").withColumn("node", _next(rows["node"], F.col("feature"), F.col("threshold"))).drop("feature", "threshold", *[f"__{c}" for c in (*keys, "node")])


def grow(rows: DataFrame, keys: list[str], features: list[str], y: str, depth: int, leaf: int = 40, bins: int = 256) -> DataFrame:
    """The node table (keys, node, n, value, feature, threshold, gain) of one tree a key over ``rows`` (keys, features, y).

    Node 1 is the root, 2 k and 2 k + 1 the children of k; ``feature`` is a place in ``features``, null at a leaf. Features
    are read as 32-bit floats; rows with a null among them or in y are left out. A level is one aggregate over the rows of all
    models; the driver sees the nodes themselves, at most 2^(depth + 1) a model. No rows, no nodes.
    """
    types = dict(rows.dtypes)
    whole = rows.select(*keys, F.col(y).alias("y"), F.array(*[F.col(c).cast("float") for c in features]).alias("x")).where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    held = _binned(whole, borders(whole, len(features), bins)).withColumn("node", F.lit(1))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", node int, n long, value double, feature int, threshold double, gain double"
    nodes: list[tuple] = []
    for level in range(depth + 1):
        found = [tuple(r) for r in best_splits(held, keys, leaf).collect()]
        split, at = level < depth, len(keys) + 3
        found = [r if split else (*r[:at], None, None, None) for r in found if r[len(keys)] >= 2**level]
        nodes += found
        open_ = [r for r in found if r[at] is not None]
        if not open_:
            break
        held = _step(held, open_, keys, schema).where(F.col("node") >= 2 ** (level + 1))
    return rows.sparkSession.createDataFrame(nodes, schema)


def predict(rows: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], depth: int, name: str = "pred") -> DataFrame:
    """``rows`` with ``node`` and ``name``: where the node table, cut at ``depth``, sends a row, and the value there; null where a feature is.

    A cut tree is what ``grow`` gives at that depth, as a node's split doesn't depend on what comes below.
    """
    held, schema = [tuple(r) for r in nodes.collect()], nodes.schema
    at = rows.withColumns({"x": F.array(*[F.col(c).cast("float") for c in features]), "node": F.lit(1)})
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    for level in range(depth):
        some = [r for r in held if 2**level <= r[len(keys)] < 2 ** (level + 1)]
        at = _step(at, some, keys, ddl)
    values = rows.sparkSession.createDataFrame(held, schema).select(*[F.col(c).alias(f"__{c}") for c in (*keys, "node")], F.col("value").alias(name))
    on = [at[c].eqNullSafe(F.col(f"__{c}")) for c in (*keys, "node")]
    out = at.join(F.broadcast(values) if len(held) <= BROADCAST_NODES else values, on, "left").drop(*[f"__{c}" for c in (*keys, "node")])
    missing = F.exists("x", lambda v: v.isNull())
    return out.withColumns({name: F.when(~missing, F.col(name)), "node": F.when(~missing, F.col("node"))}).drop("x")


def depth_errors(parted: DataFrame, keys: list[str], features: list[str], y: str, depths: tuple[int, ...] = (2, 3), leaf: int = 40, bins: int = 256) -> DataFrame:
    """(keys, depth, rmse, chosen): the error on the ``validation`` rows of ``chronological`` of trees grown on the ``fit`` rows; of equal errors
    the shallower tree is chosen. One tree is grown, to the greatest depth, and cut."""
    fit, held = (parted.where(F.col("part") == p) for p in ("fit", "validation"))
    nodes = grow(fit, keys, features, y, max(depths), leaf, bins)
    errors = None
    for d in sorted(depths):
        p = predict(held, nodes, keys, features, d)
        e = p.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col(y), F.lit(2)))).alias("rmse")).withColumn("depth", F.lit(d))
        errors = e if errors is None else errors.union(e)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("rmse", 10), "depth"))
    return errors.select(*keys, "depth", "rmse", (best == 1).alias("chosen"))


def chosen_tree(df: DataFrame, keys: list[str], features: list[str], y: str, order: str, horizon: int, depths: tuple[int, ...] = (2, 3), leaf: int = 40, bins: int = 256) -> DataFrame:
    """The node table of one tree a key over all rows of ``df``, as deep as the purged holdout chose for it."""
    parted = chronological(df.where(F.col(y).isNotNull()), keys, order, horizon)
    depth = depth_errors(parted, keys, features, y, depths, leaf, bins).where("chosen").select(*keys, "depth")
    full = grow(parted.where(F.col("part").isNotNull()), keys, features, y, max(depths), leaf, bins)
    level = F.floor(F.log2(F.col("node").cast("double")) + 1e-9)
    joined = full.join(depth, keys).where(level <= F.col("depth"))
    last = level == F.col("depth")
    return joined.select(*[F.when(~last, F.col(c)).alias(c) if c in ("feature", "threshold", "gain") else F.col(c) for c in full.columns], "depth")
