"""Strength of two forecasts of the level: boundaries on the first sessions, classes and resampled figures on the later ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import strata as S
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPLIT, DRAWS, BLOCK, SEED = 500, 2000, 12, 42


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def forecasts(spark, sf):
    """(model, s, p, y): back to the mean of 20 sessions, or against the last change; the change over six sessions, in whole units."""
    w, x = R.ordered([]), F.col("x")
    back = F.when(F.count("x").over(R.frame([], 20)) == 20, F.sum("x").over(R.frame([], 20)) - 20 * x)
    f = level(spark, sf).select("s", (F.lead("x", 6).over(w) - x).alias("y"), back.alias("back"), (F.lag("x").over(w) - x).alias("turn"))
    rows = F.array(F.struct(F.lit("back").alias("model"), (F.col("back") / F.lit(40.0)).alias("p")), F.struct(F.lit("turn").alias("model"), (F.col("turn") / F.lit(2.0)).alias("p")))
    return f.select("s", "y", F.explode(rows).alias("r")).select("r.model", "s", "r.p", "y").where("p is not null")


FORECASTS = f""", f0 AS (SELECT s, lead(x, 6) OVER (ORDER BY s) - x AS y, CASE WHEN s >= 20 THEN sum(x) OVER (ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 20 * x END AS b, lag(x) OVER (ORDER BY s) - x AS t FROM lvl),
fc AS (SELECT 'back' AS model, s, b / 40.0::DOUBLE AS p, y FROM f0 WHERE b IS NOT NULL UNION ALL SELECT 'turn', s, t / 2.0::DOUBLE, y FROM f0 WHERE t IS NOT NULL),
bd AS (SELECT model, CAST(sign(p) AS INTEGER) AS side, count(*) AS n, min(abs(p)) AS least, max(abs(p)) AS most, quantile_cont(abs(p), 1/3::DOUBLE) AS c1, quantile_cont(abs(p), 2/3::DOUBLE) AS c2 FROM fc WHERE s < {SPLIT} AND p <> 0 GROUP BY ALL),
cl AS (SELECT fc.model, s, p, y, CASE WHEN p = 0 THEN 0 WHEN c1 IS NULL OR n < 3 THEN 99 * CAST(sign(p) AS INTEGER) ELSE CAST(sign(p) AS INTEGER) * (1 + CAST(c1 < abs(p) AS INTEGER) + CAST(c2 < abs(p) AS INTEGER)) END AS code FROM fc LEFT JOIN bd ON bd.model = fc.model AND bd.side = CAST(sign(p) AS INTEGER) WHERE s >= {SPLIT})"""
DRAWN = FORECASTS + f""", pl AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT s FROM cl)),
st AS (SELECT draw, b, n, ('0x' || substr(md5('{SEED}|' || draw || '|' || b), 1, 12))::BIGINT % (n - {BLOCK - 1}) AS start FROM (SELECT DISTINCT n FROM pl WHERE n >= {BLOCK}), (SELECT unnest(range({DRAWS})) AS draw), LATERAL (SELECT unnest(range(CAST(ceil(n / {BLOCK}::DOUBLE) AS BIGINT))) AS b)),
ix AS (SELECT draw, i, count(*) AS times FROM (SELECT draw, b * {BLOCK} + k AS place, start + k AS i, n FROM st, (SELECT unnest(range({BLOCK})) AS k)) WHERE place < n GROUP BY draw, i)"""


def classes(spark, sf):
    rows = forecasts(spark, sf)
    return S.classify(rows.where(F.col("s") >= SPLIT), S.boundaries(rows.where(F.col("s") < SPLIT), ["model"], "p"), ["model"], "p")


@query("strength_boundaries", with_base(FORECASTS + " SELECT model, side, n, least, most, round(c1, 6) AS weak, round(c2, 6) AS strong FROM bd"))
def strength_boundaries(spark, sf):
    """Tertiles of each forecast's size by sign, on the sessions before the split."""
    b = S.boundaries(forecasts(spark, sf).where(F.col("s") < SPLIT), ["model"], "p")
    return b.select("model", "side", "n", "least", "most", F.round(F.col("cuts")[0], 6).alias("weak"), F.round(F.col("cuts")[1], 6).alias("strong"))


@query("strength_classes", with_base(FORECASTS + " SELECT model, code, count(*) AS n, round(avg(y), 6) AS mean, round(avg(CAST(p * y > 0 AS INTEGER)) FILTER (y <> 0), 6) AS direction FROM cl GROUP BY model, code"))
def strength_classes(spark, sf):
    """Later outcomes by class."""
    right = F.when(F.col("y") != 0, (F.col("p") * F.col("y") > 0).cast("int"))
    return classes(spark, sf).groupBy("model", "code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.avg(right), 6).alias("direction"))


@query("strata_bootstrap", with_base(DRAWN + f""", sm AS (SELECT draw, model, code, sum(times * y * sign(code)) / sum(times)::DOUBLE AS v FROM ix JOIN pl USING (i) JOIN cl USING (s) WHERE y IS NOT NULL GROUP BY ALL),
ct AS (SELECT draw, model, code AS c, v FROM sm UNION ALL SELECT draw, model, CAST(sign(code) AS INTEGER) * 31, max(v) FILTER (abs(code) = 3) - max(v) FILTER (abs(code) = 1) FROM sm WHERE abs(code) IN (1, 3) GROUP BY draw, model, sign(code))
SELECT model, CAST(c AS INTEGER) AS code, count(v) AS valid, CASE WHEN count(v) >= {int(0.9 * DRAWS)} THEN round(quantile_cont(v, 0.025::DOUBLE), 6) END AS low, CASE WHEN count(v) >= {int(0.9 * DRAWS)} THEN round(quantile_cont(v, 0.975::DOUBLE), 6) END AS high FROM ct GROUP BY model, c"""))
def strata_bootstrap(spark, sf):
    """Intervals of each class's outcome in its own direction, and (31, -31) of the strongest class less the weakest."""
    drawn = S.strata(classes(spark, sf), ["model"], "s", "y", DRAWS, BLOCK, SEED)
    apart = S.contrasts(drawn, ["model"]).select("draw", "model", (F.col("side") * 31).alias("code"), "signed_mean")
    ends = S.intervals(drawn.select("draw", "model", "code", "signed_mean").unionByName(apart), ["model", "code"], ["signed_mean"], DRAWS)
    return ends.select("model", "code", "valid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("paired_bootstrap", with_base(DRAWN + f""", g AS (SELECT draw, model, sum(times)::DOUBLE AS n, sum(times*abs(p-y))::DOUBLE AS a, sum(times*(p-y)*(p-y))::DOUBLE AS e, sum(times) FILTER (y <> 0)::DOUBLE AS m, coalesce(sum(times) FILTER (p*y > 0), 0)::DOUBLE AS h, sum(times*p)::DOUBLE AS p, sum(times*y)::DOUBLE AS t, sum(times*p*p)::DOUBLE AS pp, sum(times*y*y)::DOUBLE AS tt, sum(times*p*y)::DOUBLE AS pt FROM ix JOIN pl USING (i) JOIN cl USING (s) WHERE y IS NOT NULL GROUP BY ALL),
q AS (SELECT draw, model, a/n AS mae, sqrt(e/n) AS rmse, h/m AS direction_accuracy, (pt/n - p/n*t/n) / sqrt((pp/n - p*p/n/n) * (tt/n - t*t/n/n)) AS ic FROM g),
d AS (SELECT o.mae - r.mae AS mae, o.rmse - r.rmse AS rmse, o.direction_accuracy - r.direction_accuracy AS direction_accuracy, o.ic - r.ic AS ic FROM q o JOIN q r ON r.draw = o.draw AND r.model = 'back' AND o.model = 'turn')
SELECT 'turn' AS model, name, count(v) AS valid, round(quantile_cont(v, 0.025::DOUBLE), 6) AS low, round(quantile_cont(v, 0.975::DOUBLE), 6) AS high FROM (UNPIVOT d ON mae, rmse, direction_accuracy, ic INTO NAME name VALUE v) GROUP BY name HAVING count(v) >= {int(0.9 * DRAWS)}"""))
def paired_bootstrap(spark, sf):
    """Intervals of one forecast's errors, direction and correlation less the other's, in the same draws."""
    figures = S.forecast_figures(classes(spark, sf), "model", "s", "p", "y", DRAWS, BLOCK, SEED)
    ends = S.intervals(S.paired(figures, "model", "back"), ["model"], ["mae", "rmse", "direction_accuracy", "ic"], DRAWS)
    return ends.select("model", "name", "valid", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
