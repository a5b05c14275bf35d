"""Walk-forward queries: the level's change over six sessions by figures of each series, fitted again every twenty sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import rescreen as W
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FIT_AT = 500
BASELINES, CANDIDATES = ["change1", "change5"], ["mean5", "mean20", "spread20", "value"]


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def figures(spark, sf):
    """(k, s, level, baselines, candidates): the level in thousands and its changes, and figures of a series in hundred thousands."""
    w = R.ordered([])
    lv = level(spark, sf).select("s", (F.col("x").cast("double") / 1000).alias("level"))
    lv = lv.withColumns({"change1": F.col("level") - F.lag("level").over(w), "change5": F.col("level") - F.lag("level", 5).over(w)})
    x = F.col("x").cast("double") / 100000
    own = series(spark, sf).select("k", "s", x.alias("value"), F.avg(x).over(R.frame(["k"], 5)).alias("mean5"), F.avg(x).over(R.frame(["k"], 20)).alias("mean20"), F.stddev(x).over(R.frame(["k"], 20)).alias("spread20"))
    return own.join(F.broadcast(lv), "s")


def shown(df):
    return df.select("k", "s", "fit", "fitted_at", "n_train", F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"))


def _sql(first: str, fit: str, since: str) -> str:
    return with_base(f""", h AS (SELECT s, x::DOUBLE / 1000 AS lv, (lead(x::DOUBLE / 1000, 6) OVER (ORDER BY s)) - x::DOUBLE / 1000 AS y FROM lvl),
r AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, ser.x::DOUBLE / 100000 AS z, lv, y FROM ser JOIN h USING (s)),
q AS (SELECT *, count(y) OVER (PARTITION BY k ORDER BY i) AS nth FROM r),
e AS (SELECT k, min(i) + 6 AS enough FROM q WHERE nth >= 300 GROUP BY k),
f AS (SELECT r.*, {first} AS first, CAST({fit} AS BIGINT) AS fit FROM r JOIN e USING (k) WHERE {since}),
d AS (SELECT DISTINCT k, fit, first + 20 * fit AS fitted_at FROM f),
t AS (SELECT d.k, d.fit, any_value(fitted_at) AS fitted_at, count(*) AS n_train, avg(y) AS my, count(z) AS np, avg(z) AS m, avg(z*z) - avg(z)*avg(z) AS var, sum(z*y) - avg(z) * sum(y) FILTER (z IS NOT NULL) AS zy FROM d JOIN r ON r.k = d.k AND r.i + 6 <= d.fitted_at AND y IS NOT NULL GROUP BY d.k, d.fit)
SELECT f.k, f.s, f.fit, t.fitted_at, n_train, round(y, 6) AS y, round(my + (z - m) * zy / var / (np + 15), 6) AS prediction FROM f JOIN t ON t.k = f.k AND t.fit = f.fit""")


@query("ridge_refits", _sql("enough", "floor((i - enough) / 20)", "i >= enough"))
def ridge_refits(spark, sf):
    """One feature, fitted again every twenty sessions on all labels known by then."""
    made = W.rescreened_walk_forward(figures(spark, sf), ["k"], "s", "level", ["value"], [])
    return shown(made.where("arm = 'baseline'"))


@query("frozen_fit", _sql(str(FIT_AT), "0", f"enough <= {FIT_AT} AND i > {FIT_AT}"))
def frozen_fit(spark, sf):
    """One feature, fitted once and tried on later sessions alone."""
    made = W.rescreened_walk_forward(figures(spark, sf), ["k"], "s", "level", ["value"], [], fit_at=FIT_AT)
    return shown(made.where("arm = 'baseline'"))


@query("rescreened_walk_forward")
def rescreened_walk_forward(spark, sf):
    """Both arms with candidates screened at every fit; held to fits from the rows in the tests."""
    made = W.rescreened_walk_forward(figures(spark, sf), ["k"], "s", "level", BASELINES, CANDIDATES)
    return made.select("k", "s", "place", "arm", "fit", "fitted_at", "n_train", F.array_join("selected", ",").alias("selected"), F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"))
