"""Evaluation queries: the level's last change as the forecast of its next one, and trades on it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import evaluate as E
from tidemark.operators import stats as S
from tidemark.plans.factors import dense
from tidemark.plans.simulation import ENTRIES, entries
from tidemark.plans.statistics import PAIRS
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def forecasts(spark, sf):
    w, x = R.ordered([]), F.col("x")
    return level(spark, sf).select("s", "d", (x - F.lag(x).over(w)).alias("p"), (F.lead(x).over(w) - x).alias("y"))


FC = ", fc AS (SELECT s, d, x - lag(x) OVER (ORDER BY s) AS p, lead(x) OVER (ORDER BY s) - x AS y FROM lvl), ok AS (SELECT * FROM fc WHERE p IS NOT NULL AND y IS NOT NULL)"
METRICS_SQL = """count(*) AS n, round(CAST(sum(abs(p-y)) AS BIGINT) / count(*), 6) AS mae, round(sqrt(avg(((p-y)*(p-y))::DOUBLE)), 4) AS rmse, round(CAST(sum(p-y) AS BIGINT) / count(*), 6) AS bias, round(1 - sum(((p-y)*(p-y))::DOUBLE) / nullif(sum((y*y)::DOUBLE) - sum(y::DOUBLE)*sum(y::DOUBLE)/count(*), 0), 8) AS r2,
count(*) FILTER (y <> 0) AS direction_n, count(*) FILTER (y <> 0 AND sign(p) = sign(y)) AS direction_correct, count(*) FILTER (y <> 0 AND sign(p) = sign(y)) / nullif(count(*) FILTER (y <> 0), 0) AS direction_accuracy,
count(*) FILTER (y > 0 AND p > 0) / nullif(count(*) FILTER (y > 0), 0) AS up_recall, count(*) FILTER (y < 0 AND p < 0) / nullif(count(*) FILTER (y < 0), 0) AS down_recall, (count(*) FILTER (y > 0 AND p > 0) / nullif(count(*) FILTER (y > 0), 0) + count(*) FILTER (y < 0 AND p < 0) / nullif(count(*) FILTER (y < 0), 0)) / 2 AS balanced_accuracy,
count(*) FILTER (y > 0 AND p > 0) / nullif(count(*) FILTER (y <> 0 AND p > 0), 0) AS up_precision, count(*) FILTER (y < 0 AND p < 0) / nullif(count(*) FILTER (y <> 0 AND p < 0), 0) AS down_precision,
count(*) FILTER (y < 0 AND p < 0) AS down_said_down, count(*) FILTER (y < 0 AND p = 0) AS down_said_flat, count(*) FILTER (y < 0 AND p > 0) AS down_said_up, count(*) FILTER (y > 0 AND p < 0) AS up_said_down, count(*) FILTER (y > 0 AND p = 0) AS up_said_flat, count(*) FILTER (y > 0 AND p > 0) AS up_said_up"""


def metric_columns():
    digits = {"mae": 6, "rmse": 4, "bias": 6, "r2": 8}
    return [(F.round(c, digits[n]) if n in digits else c).alias(n) for n, c in E.extended_metrics(F.col("p"), F.col("y")).items()]


@query("extended_metrics", with_base(f"{FC} SELECT {METRICS_SQL} FROM ok"))
def extended_metrics(spark, sf):
    return forecasts(spark, sf).agg(*metric_columns())


@query("quarter_metrics", with_base(f"{FC} SELECT year(d) || '-Q' || quarter(d) AS period, {METRICS_SQL}, count(*) >= 30 AS sufficient FROM ok GROUP BY 1"))
def quarter_metrics(spark, sf):
    """Metrics by quarter, and whether it has 30 rows or more."""
    quarter = F.concat(F.year("d").cast("string"), F.lit("-Q"), F.quarter("d").cast("string")).alias("period")
    both = forecasts(spark, sf).where("p is not null and y is not null")
    return both.groupBy(quarter).agg(*metric_columns(), (F.count(F.lit(1)) >= 30).alias("sufficient"))


@query("completed_rolling", with_base(FC + ", r AS (SELECT s, CASE WHEN count(y) OVER w = 63 THEN count(CASE WHEN p IS NOT NULL AND y <> 0 AND sign(p) = sign(y) THEN 1 END) OVER w / nullif(count(CASE WHEN p IS NOT NULL AND y <> 0 THEN 1 END) OVER w, 0) END AS hit, CASE WHEN count(y) OVER w = 63 THEN CAST(sum(abs(p - y)) OVER w AS BIGINT) / count(p - y) OVER w END AS err FROM fc WINDOW w AS (ORDER BY s ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) SELECT s, lag(hit, 6) OVER (ORDER BY s) AS direction_accuracy, lag(err, 6) OVER (ORDER BY s) AS mae FROM r"))
def completed_rolling(spark, sf):
    return E.completed_rolling(forecasts(spark, sf), "p", "y", [])


PROB = ", pb AS (SELECT year(d) AS yr, (s * 37 % 101) / 101.0::DOUBLE AS p, CASE WHEN lead(x) OVER (ORDER BY s) > x THEN 1 ELSE 0 END AS up FROM lvl)"


@query("probability_metrics", with_base(PROB + " SELECT yr, count(*) AS n, round(avg((p-up)*(p-up)), 9) AS brier, round(-avg(up*ln(greatest(p, 1e-12)) + (1-up)*ln(1-greatest(p, 1e-12))), 8) AS log_loss, round(avg(CASE WHEN (p >= 0.5::DOUBLE) = (up = 1) THEN 1.0::DOUBLE ELSE 0 END), 10) AS accuracy, round(avg(p), 9) AS mean_probability, round(avg(up::DOUBLE), 10) AS up_rate FROM pb GROUP BY yr"))
def probability_metrics(spark, sf):
    f = level(spark, sf).select(F.year("d").cast("long").alias("yr"), (F.col("s") * 37 % 101 / F.lit(101.0)).alias("p"), F.coalesce((F.lead("x").over(R.ordered([])) > F.col("x")).cast("int"), F.lit(0)).alias("up"))
    digits = {"brier": 9, "log_loss": 8, "accuracy": 10, "mean_probability": 9, "up_rate": 10}
    return f.groupBy("yr").agg(*[(F.round(c, digits[n]) if n in digits else c).alias(n) for n, c in E.probability_metrics(F.col("p"), F.col("up")).items()])


TRADES = ENTRIES + ", tr AS (SELECT s, signal, year(lvl.d) AS yr, coalesce(lead(x, 6) OVER (ORDER BY s), last_value(x) OVER (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS out, lead(x, 6) OVER (ORDER BY s) IS NOT NULL AS closed, x FROM sg JOIN lvl USING (s, x)), tp AS (SELECT *, signal * (out - x) AS pnl FROM tr WHERE signal <> 0)"


def trades(spark, sf):
    """A trade of six sessions from each signal; the last ones are open and marked at the last price."""
    last = F.last("x").over(R.ordered([]).rowsBetween(0, Window.unboundedFollowing))
    out = F.lead("x", 6).over(R.ordered([]))
    t = entries(spark, sf).select("s", "signal", "x", out.isNotNull().alias("closed"), F.coalesce(out, last).alias("out"))
    return t.where("signal <> 0").withColumn("pnl", F.col("signal") * (F.col("out") - F.col("x")))


@query("trade_figures", with_base(TRADES + " SELECT signal, count(*) FILTER (closed) AS closed_n, count(*) FILTER (NOT closed) AS open_n, count(*) FILTER (closed AND pnl > 0) AS wins, count(*) FILTER (closed AND pnl < 0) AS losses, count(*) FILTER (closed AND pnl > 0) / nullif(count(*) FILTER (closed), 0) AS win_rate, CAST(sum(pnl) FILTER (closed) AS BIGINT) / nullif(count(*) FILTER (closed), 0) AS mean_pnl, CAST(coalesce(sum(pnl) FILTER (closed), 0) AS BIGINT) AS closed_pnl, CAST(coalesce(sum(pnl) FILTER (NOT closed), 0) AS BIGINT) AS floating_pnl, CAST(sum(pnl) FILTER (closed AND pnl > 0) AS BIGINT) / count(*) FILTER (closed AND pnl > 0) AS average_win, CAST(-sum(pnl) FILTER (closed AND pnl < 0) AS BIGINT) / count(*) FILTER (closed AND pnl < 0) AS average_loss, round((CAST(sum(pnl) FILTER (closed AND pnl > 0) AS BIGINT) / count(*) FILTER (closed AND pnl > 0)) / (CAST(-sum(pnl) FILTER (closed AND pnl < 0) AS BIGINT) / count(*) FILTER (closed AND pnl < 0)), 9) AS payoff_ratio, round(CAST(sum(pnl) FILTER (closed AND pnl > 0) AS BIGINT) / CAST(-sum(pnl) FILTER (closed AND pnl < 0) AS BIGINT), 9) AS profit_factor FROM tp GROUP BY signal"))
def trade_figures(spark, sf):
    figures = E.trade_figures(F.col("pnl"), F.col("closed"))
    return trades(spark, sf).groupBy("signal").agg(*[(F.round(c, 9) if n in ("payoff_ratio", "profit_factor") else c).alias(n) for n, c in figures.items()])


@query("signal_outcomes", with_base(TRADES + ", o AS (SELECT signal AS side, pnl FROM tp WHERE closed UNION ALL SELECT NULL, pnl FROM tp WHERE closed) SELECT side, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS hit, CAST(sum(pnl) AS BIGINT) / count(*) AS mean FROM o GROUP BY side"))
def signal_outcomes(spark, sf):
    t = trades(spark, sf).where("closed").withColumn("y", F.col("out") - F.col("x"))
    return E.signal_outcomes(t, "signal", "y", [])


@query("period_slices", with_base(ENTRIES + ", dp AS (SELECT sg.s, year(d) AS yr, coalesce(lag(signal) OVER (ORDER BY sg.s), 0) AS position, coalesce(lag(signal) OVER (ORDER BY sg.s) * (sg.x - lag(sg.x) OVER (ORDER BY sg.s)), 0) AS g FROM sg JOIN lvl ON lvl.s = sg.s), e AS (SELECT *, CAST(sum(g) OVER (PARTITION BY yr ORDER BY s) AS BIGINT) AS eq FROM dp), m AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY yr ORDER BY s ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e) SELECT yr, count(*) AS n, sum(g)::DOUBLE AS total, max(dd)::DOUBLE AS max_drawdown, coalesce(sum(g) FILTER (position = 1), 0)::DOUBLE AS long_pnl, coalesce(sum(g) FILTER (position = -1), 0)::DOUBLE AS short_pnl, count(*) FILTER (position <> 0) AS position_days, arg_min(position, s) <> 0 AS carried_in FROM m GROUP BY yr"))
def period_slices(spark, sf):
    """A path that holds each session's signal over the next one, cut by year with the positions carried over."""
    w = R.ordered([])
    days = level(spark, sf).select("s", F.year("d").cast("long").alias("yr"))
    held = F.coalesce(F.lag("signal").over(w), F.lit(0))
    path = entries(spark, sf).select("s", held.alias("position"), F.coalesce(held * (F.col("x") - F.lag("x").over(w)), F.lit(0)).cast("double").alias("daily_pnl"))
    return E.period_slices(path.join(days, "s"), "yr", [])


@query("paired_correctness", with_base(", f AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS a, x - lag(x, 5) OVER (ORDER BY s) AS b, lead(x) OVER (ORDER BY s) - x AS y FROM lvl), g AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND y <> 0) SELECT count(*) FILTER (sign(a) = sign(y) AND sign(b) = sign(y)) AS both, count(*) FILTER (sign(a) = sign(y) AND sign(b) <> sign(y)) AS only_a, count(*) FILTER (sign(a) <> sign(y) AND sign(b) = sign(y)) AS only_b, count(*) FILTER (sign(a) <> sign(y) AND sign(b) <> sign(y)) AS neither FROM g"))
def paired_correctness(spark, sf):
    w, x = R.ordered([]), F.col("x")
    f = level(spark, sf).select((x - F.lag(x).over(w)).alias("a"), (x - F.lag(x, 5).over(w)).alias("b"), (F.lead(x).over(w) - x).alias("y"))
    return f.agg(*[c.alias(n) for n, c in E.paired_correctness(f, "a", "b", "y").items()])


@query("jump_sensitivity", with_base(PAIRS + ", j AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY k ORDER BY s)) AS dx FROM fac), b AS (SELECT k, quantile_cont(dx::DOUBLE, 0.99) AS bound FROM j GROUP BY k), n AS (SELECT j.*, max(CASE WHEN dx > bound THEN 1 ELSE 0 END) OVER (PARTITION BY j.k ORDER BY s ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) AS near FROM j JOIN b ON b.k = j.k), r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS b FROM n WHERE near = 0) SELECT k, count(*) AS n, round(corr(a, b), 8) AS ic FROM r GROUP BY k"))
def jump_sensitivity(spark, sf):
    kept = E.without_jumps(dense(spark, sf).select("k", "s", "x", "y"), "x", ["k"])
    return S.spearman(kept, "x", "y", ["k"]).withColumn("ic", F.round("ic", 8))


@query("largest_changes", with_base(", c AS (SELECT k, s, x, lag(x) OVER (PARTITION BY k ORDER BY s) AS before FROM ser WHERE x IS NOT NULL), p AS (SELECT *, x - before AS change, row_number() OVER (PARTITION BY k ORDER BY abs(x - before) DESC, s) AS place FROM c WHERE before IS NOT NULL) SELECT k, s, x, before, change, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8"))
def largest_changes(spark, sf):
    return E.largest_changes(series(spark, sf).where("x is not null").select("k", "s", "x"), "x", ["k"])


HIST = "WITH v AS (SELECT c_nationkey AS g, c_acctbal + 1000 AS x FROM customer), s AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS sd FROM v GROUP BY g)"


@query("histogram", HIST + ", b AS (SELECT *, greatest(14, least(36, floor((hi - lo) / CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) ELSE 3.49 * sd / cbrt(n) END + 0.5))) AS bins FROM s), w AS (SELECT g, bins, greatest(0, lo - (hi - lo) / bins * 0.55::DOUBLE) AS left0, (hi + (hi - lo) / bins * 0.55::DOUBLE - greatest(0, lo - (hi - lo) / bins * 0.55::DOUBLE)) / bins AS w FROM b), c AS (SELECT v.g, CAST(least(bins - 1, greatest(0, floor((x - left0) / w))) AS INTEGER) AS bin, count(*) AS n FROM v JOIN w ON w.g = v.g GROUP BY 1, 2), gr AS (SELECT g, left0, w, CAST(unnest(range(CAST(bins AS BIGINT))) AS INTEGER) AS bin FROM w) SELECT gr.g, gr.bin, round(left0 + gr.bin * w, 6) AS left_edge, round(left0 + gr.bin * w + w, 6) AS right_edge, coalesce(c.n, 0) AS n FROM gr LEFT JOIN c ON c.g = gr.g AND c.bin = gr.bin")
def histogram(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") + 1000).alias("x"))
    return E.histogram(v, "x", ["g"]).select("g", "bin", F.round("left", 6).alias("left_edge"), F.round("right", 6).alias("right_edge"), "n")


@query("density", HIST + ", h AS (SELECT *, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * pow(n, -0.2::DOUBLE) AS h FROM s), p AS (SELECT g, n, h, CAST(unnest(range(141)) AS INTEGER) AS point, lo, hi FROM h WHERE h > 0) SELECT p.g, point, round(lo + (hi - lo) * point / 140, 6) AS x, round(sum(exp(-pow((lo + (hi - lo) * point / 140 - v.x) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density FROM p JOIN v ON v.g = p.g GROUP BY p.g, point, lo, hi")
def density(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") + 1000).alias("x"))
    return E.density(v, "x", ["g"]).select("g", "point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@query("percentile_in_sample", "SELECT p_brand, p_size AS x, 100.0::DOUBLE * (count(*) FILTER (o.s < p.p_size) + count(*) FILTER (o.s = p.p_size) / 2) / count(*) AS pct FROM (SELECT DISTINCT p_brand, p_size FROM part) p JOIN (SELECT p_brand AS b, p_size AS s FROM part) o ON o.b = p.p_brand GROUP BY p_brand, p.p_size")
def percentile_in_sample(spark, sf):
    p = table(spark, sf, "part")
    sample = p.groupBy("p_brand").agg(F.collect_list(F.col("p_size").cast("double")).alias("sample"))
    return p.select("p_brand", F.col("p_size").alias("x")).distinct().join(sample, "p_brand").select("p_brand", "x", E.percentile_in_sample(F.col("x"), "sample").alias("pct"))


@query("p_verdict", "WITH p AS (SELECT c_nationkey AS g, pow((c_custkey * 7919 % 1000) / 1000.0::DOUBLE, 1 + c_nationkey % 3) AS p FROM customer), a AS (SELECT g, count(*) AS n, avg(CASE WHEN p < 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS sh, avg(CASE WHEN p < 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS sh10, quantile_cont(p, 0.5) AS m FROM p GROUP BY g) SELECT g, n, round(sh, 9) AS share, round(sh10, 9) AS share10, round(m, 8) AS median_p, CASE WHEN sh BETWEEN 0.03::DOUBLE AND 0.09::DOUBLE AND m BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE THEN 'uniform' WHEN sh > 0.15::DOUBLE THEN 'enriched' ELSE 'deviating' END AS verdict FROM a")
def p_verdict(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.pow(k * 7919 % 1000 / F.lit(1000.0), 1 + F.col("c_nationkey") % 3).alias("p"))
    return E.p_verdict(p, "p", ["g"]).select("g", "n", F.round("share", 9).alias("share"), F.round("share10", 9).alias("share10"), F.round("median_p", 8).alias("median_p"), "verdict")
