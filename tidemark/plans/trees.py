"""Tree queries: one shallow tree a return flag over all lines, and a purged holdout over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import trees as T
from tidemark.sources.sql import with_base
from tidemark.sources.tables import series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = ["f0", "f1", "f2"]
LEAF, DEPTH = 40, 2


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def lines(spark, sf):
    """(k, y, f0, f1, f2): price in cents by quantity, discount and tax in per cent."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("k"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("y"), F.col("l_quantity").alias("f0"), F.round(F.col("l_discount") * 100).alias("f1"), F.round(F.col("l_tax") * 100).alias("f2"))


def _level(level: int, split: bool = True) -> str:
    """Best splits of the nodes of ``r{level}`` as ``n{level}``, and where its rows go as ``r{level + 1}``."""
    r = f"r{level}"
    long = " UNION ALL ".join(f"SELECT k, node, y, {i} AS f, f{i} AS v FROM {r}" for i in range(3))
    best = "f AS feature, thr AS threshold, gain" if split else "CAST(NULL AS INTEGER) AS feature, CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS gain"
    return f""", h{level} AS (SELECT k, node, f, v, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s, sum(y::DOUBLE * y) AS q FROM ({long}) GROUP BY ALL),
c{level} AS (SELECT k, node, f, v, lead(v) OVER o AS nx, sum(n) OVER u AS nl, sum(s) OVER u AS sl, sum(n) OVER p AS n, sum(s) OVER p AS s, sum(q) OVER p AS q FROM h{level} WINDOW p AS (PARTITION BY k, node, f), o AS (PARTITION BY k, node, f ORDER BY v), u AS (PARTITION BY k, node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g{level} AS (SELECT k, node, f, (v + nx) / 2 AS thr, round((sl * sl / nl + (s - sl) * (s - sl) / nullif(n - nl, 0) - s * s / n) / nullif(q - s * s / n, 0), 10) AS gain FROM c{level} WHERE nx IS NOT NULL AND nl >= {LEAF} AND n - nl >= {LEAF}),
s{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, thr) AS o FROM g{level} WHERE gain > 0) WHERE o = 1),
n{level} AS (SELECT a.k, a.node, n, value, {best} FROM (SELECT k, node, count(*) AS n, CAST(sum(y) AS DOUBLE) / count(*) AS value FROM {r} GROUP BY k, node) a LEFT JOIN s{level} s ON s.k = a.k AND s.node = a.node),
r{level + 1} AS (SELECT r.k, 2 * r.node + CASE WHEN (CASE feature WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) > threshold THEN 1 ELSE 0 END AS node, y, f0, f1, f2 FROM {r} r JOIN n{level} n ON n.k = r.k AND n.node = r.node WHERE feature IS NOT NULL)"""


TREE = "WITH r0 AS (SELECT l_returnflag AS k, 1 AS node, CAST(round(l_extendedprice * 100) AS BIGINT) AS y, l_quantity AS f0, round(l_discount * 100) AS f1, round(l_tax * 100) AS f2 FROM lineitem)" + "".join(_level(i, i < DEPTH) for i in range(DEPTH + 1))
NODES = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(DEPTH + 1))


@query("tree_nodes", TREE + f" SELECT k, CAST(node AS INTEGER) AS node, n, round(value, 4) AS value, CAST(feature AS INTEGER) AS feature, threshold, gain FROM ({NODES})")
def tree_nodes(spark, sf):
    """The node table of a tree a return flag."""
    nodes = T.grow(lines(spark, sf), ["k"], FEATURES, "y", DEPTH, LEAF)
    return nodes.withColumn("value", F.round("value", 4))


LEAVES = " UNION ALL ".join(f"SELECT r.k, r.node, y, value FROM r{i} r JOIN n{i} n ON n.k = r.k AND n.node = r.node WHERE feature IS NULL" for i in range(DEPTH + 1))


@query("tree_inference", TREE + f" SELECT k, CAST(node AS INTEGER) AS node, count(*) AS n, round(any_value(value), 4) AS pred, round(sqrt(avg((y - value) * (y - value))), 3) AS rmse FROM ({LEAVES}) GROUP BY k, node")
def tree_inference(spark, sf):
    """All lines sent through the node table: rows, value and error of each leaf."""
    rows = lines(spark, sf)
    nodes = T.grow(rows, ["k"], FEATURES, "y", DEPTH, LEAF)
    sent = T.predict(rows, nodes, ["k"], FEATURES, DEPTH)
    return sent.groupBy("k", "node").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("pred"), 4).alias("pred"), F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("pred"), F.lit(2)))), 3).alias("rmse"))


@query("holdout_parts", with_base(", h AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ser WHERE x IS NOT NULL), f AS (SELECT *, min(s) FILTER (i >= floor(n * 0.8::DOUBLE)) OVER (PARTITION BY k) AS first FROM h), p AS (SELECT k, s, CASE WHEN i >= floor(n * 0.8::DOUBLE) THEN 'validation' WHEN s + 6 < first THEN 'fit' ELSE 'purged' END AS part FROM f WHERE n >= 200) SELECT k, part, count(*) AS n, min(s) AS first, max(s) AS last FROM p GROUP BY k, part"))
def holdout_parts(spark, sf):
    """Sessions of every series by part of the purged holdout."""
    have = series(spark, sf).where("x is not null").select("k", "s")
    parts = T.chronological(have, ["k"], "s", 6, least=200).where("part is not null")
    return parts.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))
