"""Indicators, gates, events and frozen models on the series and the level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.finance import black_put, implied_volatility, probability_below, taxed_yield
from tidemark.operators import events as V
from tidemark.operators import ingest as I
from tidemark.operators import models as M
from tidemark.operators import technical as T
from tidemark.operators.screen import rolling_correlation
from tidemark.plans.rolling import _full, _w, _z
from tidemark.plans.statistics import _cdf
from tidemark.sources.sql import BASE, with_base
from tidemark.sources.tables import level, series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
x = lambda: F.col("x")


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


@query("rsi14", f"""WITH RECURSIVE {BASE}, st AS (SELECT s, greatest(x - lag(x) OVER (ORDER BY s), 0)::DOUBLE AS up, greatest(lag(x) OVER (ORDER BY s) - x, 0)::DOUBLE AS dn FROM lvl),
f AS (SELECT avg(up) AS u, avg(dn) AS d FROM st WHERE s BETWEEN 2 AND 15),
r AS (SELECT 15::BIGINT AS s, u, d FROM f UNION ALL SELECT st.s, (13 * r.u + st.up) / 14, (13 * r.d + st.dn) / 14 FROM r JOIN st ON st.s = r.s + 1)
SELECT st.s, round(CASE WHEN r.d = 0 THEN 100 ELSE 100 - 100 / (1 + r.u / r.d) END, 7) AS rsi FROM st LEFT JOIN r ON r.s = st.s""")
def rsi14(spark, sf):
    return T.rsi(level(spark, sf).select("s", F.lit(1).alias("g"), "x"), "x", ["g"]).select("s", F.round("rsi", 7).alias("rsi"))


@query("macd", f"""WITH RECURSIVE {BASE}, r AS (SELECT s, x::DOUBLE AS a, x::DOUBLE AS b, 0.0::DOUBLE AS g FROM lvl WHERE s = 1
UNION ALL SELECT l.s, r.a * (11/13) + l.x * (2/13), r.b * (25/27) + l.x * (2/27), r.g * 0.8::DOUBLE + ((r.a * (11/13) + l.x * (2/13)) - (r.b * (25/27) + l.x * (2/27))) * 0.2::DOUBLE FROM r JOIN lvl l ON l.s = r.s + 1)
SELECT s, round(a - b - g, 4) AS macd FROM r""")
def macd(spark, sf):
    return T.macd(level(spark, sf).select("s", F.lit(1).alias("g"), "x"), "x", ["g"]).select("s", F.round("macd", 4).alias("macd"))


@query("volatility20", with_base(", c AS (SELECT s, (x / lag(x) OVER (ORDER BY s) - 1) * 100 AS r FROM lvl) SELECT s, round(CASE WHEN count(r) OVER w = 20 THEN stddev_pop(r) OVER w * sqrt(242) END, 7) AS vol FROM c WINDOW w AS (ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def volatility20(spark, sf):
    c = level(spark, sf).select("s", T.percent_change(x(), 1, []).alias("r"))
    return c.select("s", F.round(T.volatility(F.col("r"), [], 20, 242, 0), 7).alias("vol"))


@query("historic_volatility", with_base(", c AS (SELECT s, ln(x / lag(x) OVER (ORDER BY s)) AS r FROM lvl) SELECT s, " + ", ".join(f"round(CASE WHEN count(r) OVER (ORDER BY s ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN 100 * stddev_samp(r) OVER (ORDER BY s ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) * sqrt(246) END, 7) AS hv{n}" for n in (20, 40, 60)) + " FROM c"))
def historic_volatility(spark, sf):
    c = level(spark, sf).select("s", F.ln(x() / F.lag(x()).over(R.ordered([]))).alias("r"))
    return c.select("s", *[F.round(100 * T.volatility(F.col("r"), [], n, 246, 1), 7).alias(f"hv{n}") for n in (20, 40, 60)])


@query("spread_changes", with_base(", a AS (SELECT a.s, a.x - b.x AS x FROM ser a JOIN ser b ON a.s = b.s WHERE a.k = '1' AND b.k = '5') SELECT s, x, CASE WHEN count(x) OVER w = 5 THEN CAST(sum(x) OVER w AS BIGINT) / 5 END AS ma5, x - lag(x) OVER (ORDER BY s) AS change1, x - lag(x, 3) OVER (ORDER BY s) AS change3, x - lag(x, 5) OVER (ORDER BY s) AS change5, x - lag(x, 10) OVER (ORDER BY s) AS change10 FROM a WINDOW w AS (ORDER BY s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def spread_changes(spark, sf):
    """Spread of two keys, its strict mean of five sessions and its changes; null where a leg is missing."""
    both = series(spark, sf)
    a, b = both.where("k = '1'").select("s", F.col("x").alias("a")), both.where("k = '5'").select("s", F.col("x").alias("b"))
    d, w = a.join(b, "s").select("s", (F.col("a") - F.col("b")).alias("x")), R.ordered([])
    return d.select("s", "x", R.mean_over(x(), R.frame([], 5), 5).alias("ma5"), *[(x() - F.lag(x(), n).over(w)).alias(f"change{n}") for n in (1, 3, 5, 10)])


@query("z_difference", with_base(f", v AS (SELECT k, s, CASE WHEN count(x) {_w(5)} = 5 THEN CAST(sum(x) {_w(5)} AS BIGINT) END AS x FROM ser), z AS (SELECT k, s, {_full(60, _z('x', 60, 42))} AS z FROM v) SELECT a.s, round(a.z - b.z, 9) AS z_difference FROM z a JOIN z b ON a.s = b.s WHERE a.k = '1' AND b.k = '5'"))
def z_difference(spark, sf):
    """Each side's sum of five sessions as z over 60, then the difference."""
    v = series(spark, sf).select("k", "s", R.sum_over(x(), R.frame(["k"], 5), 5).alias("x"))
    z = v.select("k", "s", R.full(R.frame(["k"], 60), 60, R.zscore_over(x(), R.frame(["k"], 60), 42)).alias("z"))
    a, b = z.where("k = '1'").select("s", F.col("z").alias("a")), z.where("k = '5'").select("s", F.col("z").alias("b"))
    return a.join(b, "s").select("s", F.round(F.col("a") - F.col("b"), 9).alias("z_difference"))


@query("carry", with_base(", f AS (SELECT s, x AS fund FROM ser WHERE k = '5') SELECT ser.s, round(CASE WHEN count(x) FILTER (fund IS NOT NULL) = 3 THEN 100 * sum(CASE k WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN -0.5::DOUBLE ELSE -0.5::DOUBLE END * (x - fund)) END, 4) AS carry FROM ser LEFT JOIN f ON f.s = ser.s WHERE k IN ('1','2','3') GROUP BY ser.s"))
def carry(spark, sf):
    s = series(spark, sf)
    legs = s.join(s.where("k = '5'").select("s", F.col("x").alias("fund")), "s", "left")
    return T.carry(legs, {"1": 1.0, "2": -0.5, "3": -0.5}, "k", "s", "x", "fund").withColumn("carry", F.round("carry", 4))


@query("pair_correlation", with_base(", r AS (SELECT k, s, x - lag(x) OVER (PARTITION BY k ORDER BY s) AS r FROM ser WHERE k IN ('1','2')), b AS (SELECT a.s, a.r AS a, b.r AS b FROM r a JOIN r b ON a.s = b.s WHERE a.k = '1' AND b.k = '2' AND a.r IS NOT NULL AND b.r IS NOT NULL) SELECT s, round(CASE WHEN count(*) OVER w = 60 THEN corr(a::DOUBLE, b::DOUBLE) OVER w END, 7) AS ic FROM b WINDOW w AS (ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def pair_correlation(spark, sf):
    """Correlation of two series' changes over the last 60 sessions that have both."""
    r = series(spark, sf).withColumn("r", x() - F.lag(x()).over(R.ordered(["k"])))
    a, b = (r.where(F.col("k") == k).select("s", F.col("r").alias(n)) for k, n in (("1", "a"), ("2", "b")))
    both = a.join(b, "s").where("a is not null and b is not null")
    return both.select("s", F.round(rolling_correlation("a", "b", [], 60), 7).alias("ic"))


HISTORY = ", p AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS p FROM lvl), h AS (SELECT s, p, list_filter(list(p) OVER (ORDER BY s ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL) AS h FROM p)"


def forecasts_with_history(spark, sf):
    """(s, p, h): a forecast each session and those of the 250 sessions before it."""
    p = level(spark, sf).select("s", (x() - F.lag(x()).over(R.ordered([]))).alias("p"))
    return p.select("s", "p", F.filter(F.collect_list(F.struct(F.col("p").alias("v"))).over(R.frame([], 250, last=-1)), lambda r: r["v"].isNotNull()).alias("h")).select("s", "p", F.transform("h", lambda r: r["v"]).alias("h"))


@query("gate_size", with_base(HISTORY + " SELECT s, coalesce(len(h), 0) AS history_n, CASE WHEN len(h) >= 60 AND p IS NOT NULL THEN 50.0::DOUBLE * (2*len(list_filter(h, lambda v: abs(v) < abs(p))) + len(list_filter(h, lambda v: abs(v) = abs(p)))) / len(h) END AS pct, CAST(CASE WHEN len(h) >= 60 AND p <> 0 AND 50.0::DOUBLE * (2*len(list_filter(h, lambda v: abs(v) < abs(p))) + len(list_filter(h, lambda v: abs(v) = abs(p)))) / len(h) > 60 THEN sign(p) ELSE 0 END AS INTEGER) AS signal FROM h"))
def gate_size(spark, sf):
    """Signal of a forecast whose size is over the 60th percentile of those issued before it."""
    h, p = F.col("h"), F.col("p")
    less, same = F.size(F.filter(h, lambda v: F.abs(v) < F.abs(p))), F.size(F.filter(h, lambda v: F.abs(v) == F.abs(p)))
    pct = F.when((F.size(h) >= 60) & p.isNotNull(), F.lit(50.0) * (2 * less + same) / F.size(h))
    out = forecasts_with_history(spark, sf).select("s", F.size(h).cast("long").alias("history_n"), pct.alias("pct"), "p")
    return out.select("s", "history_n", "pct", F.when((F.col("pct") > 60) & (p != 0), F.signum(p.cast("double"))).otherwise(0).cast("int").alias("signal"))


@query("gate_quantiles", with_base(HISTORY + ", q AS (SELECT s, CASE WHEN len(h) >= 60 AND p IS NOT NULL THEN list_sort(h) END AS o FROM h) SELECT s, " + ", ".join(f"o[1 + CAST(floor({q} * (len(o) - 1)) AS INTEGER)] + ({q}::DOUBLE * (len(o) - 1) - floor({q}::DOUBLE * (len(o) - 1))) * (o[least(len(o), 2 + CAST(floor({q} * (len(o) - 1)) AS INTEGER))] - o[1 + CAST(floor({q} * (len(o) - 1)) AS INTEGER)]) AS {n}" for q, n in ((0.4, "lower_quantile"), (0.6, "quantile"))) + " FROM q"))
def gate_quantiles(spark, sf):
    """The forecasts at 40 and 60 % of those before, interpolated."""

    def at(q):
        o, place = F.col("o"), F.lit(q) * (F.size("o") - 1)
        low = F.floor(place).cast("int")
        a, b = F.get(o, low), F.get(o, F.least(low + 1, F.size(o) - 1))
        return a + (place - low) * (b - a)

    h = forecasts_with_history(spark, sf).select("s", F.when((F.size("h") >= 60) & F.col("p").isNotNull(), F.array_sort("h")).alias("o"))
    return h.select("s", at(0.4).alias("lower_quantile"), at(0.6).alias("quantile"))


@query("stake", with_base(", p AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS p FROM lvl), h AS (SELECT s, p, list(p) OVER (ORDER BY s ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS h FROM p WHERE p IS NOT NULL), q AS (SELECT s, p, CASE WHEN len(h) >= 60 THEN len(list_filter(h, lambda v: v <= p)) / len(h) END AS q FROM h) SELECT s, 2 * q - 1 AS by_quantile, CASE WHEN q >= 0.7::DOUBLE THEN 1 WHEN q <= 0.3::DOUBLE THEN -1 ELSE 0 END AS by_band, CASE WHEN p >= 0 THEN 1 ELSE -1 END AS by_sign FROM q"))
def stake(spark, sf):
    """Position size from a forecast's rank among the 250 issued before it (sessions without one don't count)."""
    p = level(spark, sf).select("s", (x() - F.lag(x()).over(R.ordered([]))).alias("p")).where("p is not null")
    h = p.withColumn("h", F.collect_list("p").over(R.frame([], 250, last=-1)))
    q = h.withColumn("q", F.when(F.size("h") >= 60, F.size(F.filter("h", lambda v: v <= F.col("p"))) / F.size("h")))
    return q.select("s", (2 * F.col("q") - 1).alias("by_quantile"), F.when(F.col("q") >= 0.7, 1).when(F.col("q") <= 0.3, -1).otherwise(0).alias("by_band"), F.when(F.col("p") >= 0, 1).otherwise(-1).alias("by_sign"))


@query("entry_gates", with_base(", p AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS p FROM lvl) SELECT s, CAST(sign(p) AS INTEGER) AS by_sign, CASE WHEN p > 0 THEN 1 WHEN p < -20000 THEN -1 WHEN p IS NOT NULL THEN 0 END AS asymmetric FROM p"))
def entry_gates(spark, sf):
    """Entries by sign, and by sign with a cut that only the negative side must pass."""
    p = level(spark, sf).select("s", (x() - F.lag(x()).over(R.ordered([]))).alias("p"))
    return p.select("s", F.signum(F.col("p").cast("double")).cast("int").alias("by_sign"), F.when(F.col("p") > 0, 1).when(F.col("p") < -20000, -1).when(F.col("p").isNotNull(), 0).alias("asymmetric"))


@query("rolling_profit", with_base(", g AS (SELECT s, x - lag(x) OVER (ORDER BY s) AS g FROM lvl) SELECT s, CASE WHEN count(g) OVER a = 30 THEN CAST(sum(g) OVER a AS BIGINT) END AS profit30, CASE WHEN count(g) OVER b = 60 THEN CAST(sum(g) OVER b AS BIGINT) END AS profit60 FROM g WINDOW a AS (ORDER BY s ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), b AS (ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def rolling_profit(spark, sf):
    g = level(spark, sf).select("s", (x() - F.lag(x()).over(R.ordered([]))).alias("g"))
    return g.select("s", *[R.sum_over(F.col("g"), R.frame([], n), n).alias(f"profit{n}") for n in (30, 60)])


@query("grid_scan", with_base(", b AS (SELECT s, x, lag(x) OVER (ORDER BY s) AS before, lead(x, 5) OVER (ORDER BY s) AS x5, lead(x, 10) OVER (ORDER BY s) AS x10 FROM lvl), g AS (SELECT t AS threshold, CAST(w AS INTEGER) AS win, (x - CASE w WHEN 5 THEN x5 ELSE x10 END)::DOUBLE AS r FROM b CROSS JOIN (SELECT unnest([240000.0::DOUBLE, 255000, 270000]) AS t) q CROSS JOIN (SELECT unnest([5, 10]) AS w) v WHERE x > t AND before <= t) SELECT threshold, win AS window_, count(r) AS n, round(avg(r), 6) AS mean, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 7) AS t, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS win_rate FROM g WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(r) >= 5"))
def grid_scan(spark, sf):
    out = V.grid_scan(level(spark, sf), "x", "x", [240000, 255000, 270000], [5, 10])
    return out.select("threshold", F.col("window").alias("window_"), "n", F.round("mean", 6).alias("mean"), F.round("t", 7).alias("t"), F.round("win_rate", 9).alias("win_rate"))


@query("drawdown_events", f"""WITH RECURSIVE {BASE}, a AS (SELECT s, x, x / max(x) OVER (ORDER BY s ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) - 1 AS dd, min(x) OVER (ORDER BY s ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / x - 1 AS worst, lead(x, 20) OVER (ORDER BY s) / x - 1 AS terminal FROM lvl),
c AS (SELECT *, row_number() OVER (ORDER BY s) AS n FROM (SELECT *, lag(dd) OVER (ORDER BY s) AS before FROM a) WHERE dd <= -0.25::DOUBLE AND before > -0.25::DOUBLE AND terminal IS NOT NULL),
k AS (SELECT n, s AS last, true AS took FROM c WHERE n = 1 UNION ALL SELECT c.n, CASE WHEN c.s - k.last >= 10 THEN c.s ELSE k.last END, c.s - k.last >= 10 FROM k JOIN c ON c.n = k.n + 1)
SELECT c.s, round(dd, 10) AS dd, round(worst, 10) AS worst, round(terminal, 10) AS terminal, worst <= -0.1::DOUBLE AS touched FROM c JOIN k ON k.n = c.n WHERE took""")
def drawdown_events(spark, sf):
    out = V.drawdown_events(level(spark, sf), "x", 0.25, 20, 10, 0.1)
    return out.select("s", *[F.round(c, 10).alias(c) for c in ("dd", "worst", "terminal")], "touched")


@query("bands", with_base(", v AS (SELECT s, x AS a, lead(x) OVER (ORDER BY s) AS b FROM lvl), z AS (SELECT s, CASE WHEN a > avg(a) OVER () AND b > avg(b) OVER () THEN 1 WHEN a < avg(a) OVER () AND b < avg(b) OVER () THEN -1 ELSE 0 END AS sg FROM v), r AS (SELECT s, sg, row_number() OVER (ORDER BY s) - row_number() OVER (PARTITION BY sg ORDER BY s) AS run FROM z) SELECT CAST(sg AS INTEGER) AS sign, min(s) AS first_s, max(s) AS last_s, count(*) AS n FROM r WHERE sg <> 0 GROUP BY sg, run"))
def bands(spark, sf):
    v = level(spark, sf).select("s", x().alias("a"), F.lead(x()).over(R.ordered([])).alias("b"))
    return V.bands(v, "a", "b").select("sign", F.col("first").alias("first_s"), F.col("last").alias("last_s"), "n")


FEATURES = ("p_size", "p_retailprice")
SCALER = "WITH l AS (SELECT p_partkey, 'p_size' AS feature, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size::DOUBLE END AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), m AS (SELECT feature, quantile_cont(v, 0.5) AS median FROM l GROUP BY feature), f AS (SELECT p_partkey, l.feature, l.v AS raw, coalesce(v, median) AS v, median FROM l JOIN m ON m.feature = l.feature), q AS (SELECT feature, any_value(median) AS median, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high FROM f GROUP BY feature), c AS (SELECT p_partkey, f.feature, raw, f.v, least(greatest(f.v, low), high) AS cut, q.median, low, high FROM f JOIN q ON q.feature = f.feature), sc AS (SELECT feature, any_value(median) AS median, any_value(low) AS low, any_value(high) AS high, avg(cut) AS mean, CASE WHEN stddev_pop(cut) > 1e-10 THEN stddev_pop(cut) ELSE 1 END AS sd FROM c GROUP BY feature)"


def parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")


@query("scaler", SCALER + " SELECT feature, median, round(low, 8) AS low, round(high, 8) AS high, round(mean, 7) AS mean, round(sd, 7) AS sd FROM sc")
def scaler(spark, sf):
    out = M.fit_scaler(parts(spark, sf), list(FEATURES))
    return out.select("feature", "median", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), F.round("mean", 7).alias("mean"), F.round("sd", 7).alias("sd"))


def frozen(spark, sf):
    """Long rows of the features, and a model with set weights."""
    p = parts(spark, sf)
    model = M.fit_scaler(p, list(FEATURES)).withColumn("weight", F.when(F.col("feature") == "p_size", 0.75).otherwise(-0.5))
    return p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in FEATURES])).alias("r")).select("p_partkey", "r.*"), model


SCORED = SCALER + ", t AS (SELECT p_partkey, c.feature, raw, v, cut, (cut - mean) / sd * CASE WHEN c.feature = 'p_size' THEN 0.75::DOUBLE ELSE -0.5::DOUBLE END AS term FROM c JOIN sc ON sc.feature = c.feature), sm AS (SELECT p_partkey, 0.1::DOUBLE + sum(term) AS score, count(*) FILTER (raw IS NULL) AS n_missing, count(*) FILTER (cut <> v) AS n_clipped FROM t GROUP BY p_partkey)"


@query("frozen_inference", SCORED + " SELECT p_partkey, round(score, 8) AS score, n_missing, n_clipped, round(1 / (1 + exp(-score)), 9) AS probability FROM sm")
def frozen_inference(spark, sf):
    rows, model = frozen(spark, sf)
    return M.infer(rows, model, ["p_partkey"], 0.1).select("p_partkey", F.round("score", 8).alias("score"), "n_missing", "n_clipped", F.round(M.sigmoid(F.col("score")), 9).alias("probability"))


@query("top_contribution", SCORED + ", o AS (SELECT p_partkey, feature, term, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(term) DESC, feature) AS place FROM t) SELECT p_partkey, feature, round(term, 8) AS contribution FROM o WHERE place = 1")
def top_contribution(spark, sf):
    """The feature that moves each score most."""
    rows, model = frozen(spark, sf)
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc(F.abs("contribution")), "feature"))
    return M.contributions(rows, model, ["p_partkey"]).withColumn("place", place).where("place = 1").select("p_partkey", "feature", F.round("contribution", 8).alias("contribution"))


@query("implied_volatility", f"WITH p AS (SELECT p_partkey, p_retailprice AS f, p_retailprice * (0.9::DOUBLE + (p_partkey % 3) / 10.0::DOUBLE) AS k, (0.15::DOUBLE + (p_partkey % 4) / 20.0::DOUBLE) AS v, (p_size + 5) / 50.0::DOUBLE AS t FROM part) SELECT p_partkey, round(v, 5) AS vol, round({_cdf('(-(ln(f/(k*0.9::DOUBLE))/(v*sqrt(t)) - v*sqrt(t)/2))')}, 8) AS below FROM p")
def implied(spark, sf):
    """The volatility that a price was made with is found again; and the chance of a tenth under the strike."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("f"), (F.col("p_retailprice") * (F.lit(0.9) + k % 3 / F.lit(10.0))).alias("k"), (F.lit(0.15) + k % 4 / F.lit(20.0)).alias("v"), ((F.col("p_size") + 5) / F.lit(50.0)).alias("t"))
    priced = p.withColumn("price", black_put(F.col("f"), F.col("k"), F.col("v"), F.col("t"))["price"])
    return priced.select("p_partkey", F.round(implied_volatility(F.col("price"), F.col("f"), F.col("k"), F.col("t")), 5).alias("vol"), F.round(probability_below(F.col("k") * 0.9, F.col("f"), F.col("v"), F.col("t")), 8).alias("below"))


@query("strike_ladder", "SELECT p_partkey, strike, CASE WHEN strike < f * 0.99::DOUBLE THEN 'below' WHEN strike > f * 1.01::DOUBLE THEN 'above' ELSE 'at' END AS side FROM (SELECT p_partkey, p_retailprice AS f, unnest(range(CAST(floor(p_retailprice / 100) AS BIGINT) * 100 - 300, CAST(floor(p_retailprice / 100) AS BIGINT) * 100 + 301, 50)) AS strike FROM part) q")
def strike_ladder(spark, sf):
    base = F.floor(F.col("p_retailprice") / 100) * 100
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("f"), F.explode(F.sequence(base - 300, base + 300, F.lit(50).cast("long"))).alias("strike"))
    return p.select("p_partkey", "strike", F.when(F.col("strike") < F.col("f") * 0.99, "below").when(F.col("strike") > F.col("f") * 1.01, "above").otherwise("at").alias("side"))


@query("taxed_yield", "SELECT s_suppkey, round((2 + s_suppkey % 7 / 10.0::DOUBLE) * 1.06::DOUBLE / 0.75::DOUBLE, 10) AS y FROM supplier")
def taxed(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.round(taxed_yield(2 + F.col("s_suppkey") % 7 / F.lit(10.0), F.lit(0.06), F.lit(0.25)), 10).alias("y"))


@query("compact_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def compact_dates(spark, sf):
    number = F.when(F.col("o_orderkey") % 10 == 0, F.lit(20241399)).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", I.compact_date(number).alias("d"))


@query("normalise_names", "SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#1\\d') THEN 'ten-' || substr(p_brand, 8) WHEN regexp_full_match(p_brand, 'Brand#2\\d') THEN 'twenty' ELSE p_brand END AS name FROM part")
def normalise_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", I.normalise_names(F.concat(F.lit(" "), "p_brand"), [(r"Brand#1(\d)", "ten-$1"), (r"Brand#2\d", "twenty")]).alias("name"))


@query("recovered_duration", "WITH o AS (SELECT o_custkey AS k, o_orderkey AS i, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) / 10.0::DOUBLE END AS v FROM orders), l AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN {'d': d, 'i': i, 'v': v} END) OVER (PARTITION BY k ORDER BY d, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o) SELECT i, round(coalesce(v, greatest(p.v - date_diff('day', p.d, d) / 365, 0)), 10) AS v, v IS NULL AND p IS NOT NULL AS recovered FROM l")
def recovered_duration(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100 / F.lit(10.0)).alias("v"))
    return I.recovered_duration(o, "k", "d", "v", "i").select("i", F.round("v", 10).alias("v"), "recovered")


@query("quality_gate", "SELECT c_custkey, list_filter([CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'balance' END, CASE WHEN NOT coalesce(c_nationkey < 20, false) THEN 'nation' END, CASE WHEN NOT coalesce(c_mktsegment <> 'BUILDING', false) THEN 'segment' END], lambda v: v IS NOT NULL) AS problems FROM customer")
def quality_gate(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", I.problems({"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") < 20, "segment": F.col("c_mktsegment") != "BUILDING"}).alias("problems"))


@query("thinned", with_base(", h AS (SELECT k, s, x, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ser WHERE x IS NOT NULL) SELECT k, s, x FROM h WHERE n <= 120 OR i = 0 OR floor(i * 119 / (n - 1)) > floor((i - 1) * 119 / (n - 1))"))
def thinned(spark, sf):
    return I.thinned(series(spark, sf).select("k", "s", "x"), "x", ["k"], 120)


@query("latest_rows", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS p FROM orders) WHERE p <= 3")
def latest_rows(spark, sf):
    return I.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 3, "o_orderkey")


@query("above_group_percentile", "WITH q AS (SELECT c_nationkey AS g, quantile_cont(abs(c_acctbal), 0.8) AS cut FROM customer GROUP BY 1) SELECT c_custkey FROM customer JOIN q ON g = c_nationkey WHERE abs(c_acctbal) >= cut")
def above_group_percentile(spark, sf):
    return I.above_group_percentile(table(spark, sf, "customer"), "c_acctbal", "c_nationkey", 0.8).select("c_custkey")


@query("keep_longer", "WITH a AS (SELECT o_orderpriority AS k, o_orderkey AS i FROM orders), b AS (SELECT k, i FROM a WHERE k <> '1-URGENT' OR i % 2 = 0), n AS (SELECT a.k, count(*) AS na FROM a GROUP BY 1), m AS (SELECT k, count(*) AS nb FROM b GROUP BY 1), o AS (SELECT n.k FROM n LEFT JOIN m USING (k) WHERE coalesce(nb, 0) + 5 < na) SELECT k, i FROM b WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, i FROM a WHERE k IN (SELECT k FROM o)")
def keep_longer(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("i"))
    return I.keep_longer(a, a.where("k <> '1-URGENT' or i % 2 = 0"), "k")
