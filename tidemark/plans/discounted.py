"""The discounted linear model's queries: the level's change over six sessions by each series, over a grid of discounts and spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import discounted as D
from tidemark.plans.statistics import _cdf
from tidemark.sources.sql import BASE
from tidemark.sources.tables import level, series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
START, UNTIL, DELAY, PENALTY = 400, 700, 6, 15.0
DISCOUNTS, SPREADS = [1.0, 0.995, 0.98], [1.0, 6.0, 18.0]


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def model_rows(spark, sf):
    """(k, s, z, y): a series' value, scaled, null where it has none; the level's change over six sessions in thousands."""
    x = F.col("x").cast("double")
    change = level(spark, sf).select("s", ((F.lead("x", DELAY).over(R.ordered([])) - F.col("x")).cast("double") / 1000).alias("y"))
    return series(spark, sf).select("k", "s", ((x - 150000) / 100000).alias("z")).join(F.broadcast(change), "s")


def grid(spark, sf):
    return D.filter_grid(model_rows(spark, sf), ["k"], "s", ["z"], "y", START, DISCOUNTS, SPREADS, DELAY, PENALTY)


GRID = f"""WITH RECURSIVE {BASE},
c0 AS (SELECT s, (lead(x, {DELAY}) OVER (ORDER BY s) - x)::DOUBLE / 1000 AS y FROM lvl),
r AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, (x::DOUBLE - 150000) / 100000::DOUBLE AS z, y FROM ser JOIN c0 USING (s)),
ok AS (SELECT k, i FROM r WHERE z IS NOT NULL AND y IS NOT NULL),
t AS (SELECT k, max(i) AS last, count(*)::DOUBLE AS n, sum(z) AS sz, sum(z*z) AS szz, sum(y) AS sy, sum(z*y) AS szy, sum(y*y) AS syy FROM r JOIN ok USING (k, i) WHERE i < {START - DELAY} GROUP BY k HAVING count(*) > 1),
w AS (SELECT *, sy / n AS m, (szy - sz * sy / n) / (szz + {PENALTY}::DOUBLE) AS b FROM t),
p AS (SELECT *, greatest((syy - 2 * (m*sy + b*szy) + m*m*n + 2*m*b*sz + b*b*szz) / n, 1e-6::DOUBLE) AS noise FROM w),
nx AS (SELECT r.k, i, min(CASE WHEN z IS NOT NULL AND y IS NOT NULL THEN i END) OVER (PARTITION BY r.k ORDER BY i RANGE BETWEEN {DELAY} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM r),
tk AS (SELECT p.k, nx.nxt AS i FROM p JOIN nx ON nx.k = p.k AND nx.i = p.last WHERE nxt IS NOT NULL UNION ALL SELECT tk.k, nx.nxt FROM tk JOIN nx ON nx.k = tk.k AND nx.i = tk.i WHERE nx.nxt IS NOT NULL),
g AS (SELECT r.k, r.s, r.i, r.z, r.y, p.n, p.sz, p.szz, p.m, p.b, p.noise, tk.i IS NOT NULL AS take, d, pow(d, p.last - r.i) AS wt FROM r JOIN p ON p.k = r.k LEFT JOIN tk ON tk.k = r.k AND tk.i = r.i CROSS JOIN (SELECT unnest([{', '.join(f'{d}::DOUBLE' for d in DISCOUNTS)}]) AS d) q),
u AS (SELECT *, coalesce(sum(wt) FILTER (take) OVER o, 0) AS u0, coalesce(sum(wt*z) FILTER (take) OVER o, 0) AS uz, coalesce(sum(wt*z*z) FILTER (take) OVER o, 0) AS uzz, coalesce(sum(wt*y) FILTER (take) OVER o, 0) AS uy, coalesce(sum(wt*z*y) FILTER (take) OVER o, 0) AS uzy, lag(take, {DELAY}) OVER (PARTITION BY k, d ORDER BY i) AS updated FROM g WINDOW o AS (PARTITION BY k, d ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND {DELAY} PRECEDING)),
e AS (SELECT k, s, i, y, z, d, c, noise, wt, updated, n/c + u0 AS a, sz/c + uz AS ab, (szz + {PENALTY}::DOUBLE)/c + uzz AS bb, (n*m + sz*b)/c + uy AS h, (sz*m + (szz + {PENALTY}::DOUBLE)*b)/c + uzy AS hb FROM u CROSS JOIN (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in SPREADS)}]) AS c) q WHERE i >= {START}),
f AS (SELECT k, s, i, y, d, c, updated, (bb*h - ab*hb + z*(a*hb - ab*h)) / (a*bb - ab*ab) AS mean, sqrt(noise * (1 + wt * (bb - 2*ab*z + a*z*z) / (a*bb - ab*ab))) AS sd FROM e),
v AS (SELECT k, d, c, count(*) AS n, sqrt(avg((mean - y) * (mean - y))) AS rmse FROM f WHERE i + {DELAY} < {UNTIL} AND y IS NOT NULL AND mean IS NOT NULL GROUP BY k, d, c),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(rmse, 10), d DESC, c) = 1 AS chosen FROM v)
"""


@query("filter_grid", GRID + "SELECT k, d AS discount, c AS spread, n, round(rmse, 6) AS rmse, chosen FROM best")
def filter_grid(spark, sf):
    """Validation errors of nine filters a series, and the one chosen."""
    return D.grid_errors(grid(spark, sf), ["k"], UNTIL, DELAY).withColumn("rmse", F.round("rmse", 6))


@query("filter_forecasts", GRID + f"SELECT k, s, y, d AS discount, c AS spread, round(mean, 6) AS mean, round(sd, 6) AS sd, updated, round({_cdf('(mean/sd)')}, 6) AS up, round(mean - {D.Z80}::DOUBLE*sd, 6) AS low, round(mean + {D.Z80}::DOUBLE*sd, 6) AS high FROM f JOIN best USING (k, d, c) WHERE chosen AND i >= {UNTIL}")
def filter_forecasts(spark, sf):
    """Forecasts after the validation by each series' chosen filter, the probability of a rise and the middle 80 %."""
    made = grid(spark, sf)
    out = D.chosen_forecasts(made, D.grid_errors(made, ["k"], UNTIL, DELAY), ["k"], UNTIL)
    return out.select("k", "s", "y", "discount", "spread", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "up", "low", "high")], "updated")


@query("filter_calibration", GRID + f"SELECT k, count(*) AS n, round(avg(abs(y - mean)), 6) AS mae, round(avg(CAST(abs(y - mean) <= {D.Z80}::DOUBLE*sd AS INTEGER)), 6) AS coverage, round(avg(({_cdf('(mean/sd)')} - CAST(y > 0 AS INTEGER)) * ({_cdf('(mean/sd)')} - CAST(y > 0 AS INTEGER))), 6) AS brier, count(*) FILTER (updated) AS updates FROM f JOIN best USING (k, d, c) WHERE chosen AND i >= {UNTIL} AND y IS NOT NULL AND mean IS NOT NULL GROUP BY k")
def filter_calibration(spark, sf):
    """How well the chosen filters' spread fits: absolute error, share inside the middle 80 %, Brier score of the rise."""
    made = grid(spark, sf)
    out = D.chosen_forecasts(made, D.grid_errors(made, ["k"], UNTIL, DELAY), ["k"], UNTIL).where("y is not null and mean is not null")
    rise, err = (F.col("y") > 0).cast("int"), F.abs(F.col("y") - F.col("mean"))
    inside = F.avg((err <= F.lit(D.Z80) * F.col("sd")).cast("int"))
    brier = F.avg((F.col("up") - rise) * (F.col("up") - rise))
    return out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(err), 6).alias("mae"), F.round(inside, 6).alias("coverage"), F.round(brier, 6).alias("brier"), F.count_if("updated").alias("updates"))
