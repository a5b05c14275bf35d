"""Aggregates, tests and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.functions.finance import black_put, normal_cdf, wilson
from tidemark.operators import stats as S
from tidemark.operators.relational import weighted_rate
from tidemark.operators.simulate import simulate
from tidemark.sources.sql import with_base
from tidemark.sources.tables import level, orders_by_day, series, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name, sql):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


@query("daily_sum", with_base("SELECT d, CAST(sum(c) AS BIGINT) AS total, count(*) AS n FROM ord WHERE k IN ('1','2') AND st = 'O' GROUP BY d"))
def daily_sum(spark, sf):
    o = orders_by_day(spark, sf).where(F.col("k").isin("1", "2") & (F.col("st") == "O"))
    return o.groupBy("d").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"))


@query("panel_presence", with_base("SELECT k, count(*) AS sessions, count(x) AS filled, CAST(sum(x) AS BIGINT) AS total FROM ser GROUP BY k"))
def panel_presence(spark, sf):
    return series(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("sessions"), F.count("x").alias("filled"), F.sum("x").alias("total"))


@query("weighted_rate", "SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / nullif(sum(l_extendedprice), 0), 8) AS rate FROM lineitem WHERE l_extendedprice <> 0 GROUP BY 1")
def weighted(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(weighted_rate(F.col("l_discount"), F.col("l_extendedprice")), 8).alias("rate"))


@query("distinct_values", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, list_sort(list(DISTINCT o_orderpriority))::VARCHAR[] AS priorities, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1")
def distinct_values(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("quantiles", with_base("SELECT k, quantile_cont(x::DOUBLE, 0.01) AS q01, quantile_cont(x::DOUBLE, 0.5) AS q50, quantile_cont(x::DOUBLE, 0.99) AS q99 FROM ser GROUP BY k"))
def quantiles(spark, sf):
    p = F.percentile("x", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    return series(spark, sf).groupBy("k").agg(p.alias("p")).select("k", F.col("p")[0].alias("q01"), F.col("p")[1].alias("q50"), F.col("p")[2].alias("q99"))


@query("moments", with_base("SELECT k, round(avg(x::DOUBLE), 6) AS mean, round(stddev_samp(x::DOUBLE), 4) AS sd, round(stddev_pop(x::DOUBLE), 4) AS sd0, round(kurtosis_pop(x::DOUBLE), 8) AS kurt FROM ser GROUP BY k"))
def moments(spark, sf):
    x = F.col("x").cast("double")
    return series(spark, sf).groupBy("k").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.round(F.stddev_pop(x), 4).alias("sd0"), F.round(F.kurtosis(x), 8).alias("kurt"))


@query("autocorrelation", with_base(", p AS (SELECT k, x::DOUBLE AS x, lag(x) OVER (PARTITION BY k ORDER BY s)::DOUBLE AS y FROM ser) SELECT k, round(corr(x, y), 8) AS ac1 FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY k"))
def autocorrelation(spark, sf):
    p = series(spark, sf).withColumn("y", F.lag("x").over(R.ordered(["k"]))).where("x is not null and y is not null")
    return p.groupBy("k").agg(F.round(F.corr("x", "y"), 8).alias("ac1"))


PAIRS = ", lab AS (SELECT s, d, x, lead(x, 6) OVER (ORDER BY s) - x AS y FROM lvl), fac AS (SELECT k, ser.s, ser.d, ser.x, lab.y FROM ser JOIN lab USING (s) WHERE ser.x IS NOT NULL AND lab.y IS NOT NULL)"


def pairs(spark, sf):
    lab = level(spark, sf).select("s", (F.lead("x", 6).over(R.ordered([])) - F.col("x")).alias("y"))
    return series(spark, sf).join(lab, "s").where("x is not null and y is not null")


@query("pearson_ic", with_base(f"{PAIRS} SELECT k, count(*) AS n, round(corr(x::DOUBLE, y::DOUBLE), 8) AS ic FROM fac GROUP BY k"))
def pearson_ic(spark, sf):
    return pairs(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 8).alias("ic"))


RANKED = ", rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2.0::DOUBLE AS b FROM fac)"


@query("spearman_ic", with_base(f"{PAIRS}{RANKED.format(k='k')} SELECT k, count(*) AS n, round(corr(a, b), 8) AS ic FROM rk GROUP BY k"))
def spearman_ic(spark, sf):
    return S.spearman(pairs(spark, sf), "x", "y", ["k"]).withColumn("ic", F.round("ic", 8))


@query("yearly_ic", with_base(f"{PAIRS.replace('SELECT k, ser.s', 'SELECT year(ser.d) AS yr, k, ser.s')}{RANKED.format(k='k, yr')} SELECT k, yr, count(*) AS n, round(corr(a, b), 8) AS ic FROM rk GROUP BY k, yr"))
def yearly_ic(spark, sf):
    out = S.spearman(pairs(spark, sf).withColumn("yr", F.year("d").cast("long")), "x", "y", ["k", "yr"])
    return out.withColumn("ic", F.round("ic", 8))


@query("blocked_ic", with_base(f"{PAIRS}, b AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY s) - 1) // 20 AS block, x::DOUBLE AS x, y::DOUBLE AS y FROM fac), c AS (SELECT k, block, corr(x, y) AS ic FROM b GROUP BY k, block HAVING count(*) = 20) SELECT k, count(*) AS blocks, round(avg(ic) / stddev_samp(ic), 7) AS icir FROM c GROUP BY k"))
def blocked_ic(spark, sf):
    b = pairs(spark, sf).withColumn("block", F.floor((F.row_number().over(R.ordered(["k"])) - 1) / 20))
    c = b.groupBy("k", "block").agg(F.corr("x", "y").alias("ic"), F.count(F.lit(1)).alias("n")).where("n = 20")
    return c.groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("ic") / F.stddev_samp("ic"), 7).alias("icir"))


@query("ols", with_base(f"{PAIRS} SELECT k, round(regr_slope(y::DOUBLE, x::DOUBLE), 8) AS slope, round(regr_intercept(y::DOUBLE, x::DOUBLE), 2) AS intercept FROM fac GROUP BY k"))
def ols(spark, sf):
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return pairs(spark, sf).groupBy("k").agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"))


@query("nw_t", with_base(f"{PAIRS}, o AS (SELECT k, s, x::DOUBLE - avg(x::DOUBLE) OVER (PARTITION BY k) AS xc, y::DOUBLE - avg(y::DOUBLE) OVER (PARTITION BY k) AS yc FROM fac), b AS (SELECT k, sum(xc*yc)/sum(xc*xc) AS beta, sum(xc*xc) AS sxx FROM o GROUP BY k), u AS (SELECT k, s, beta, sxx, xc*(yc-beta*xc) AS u FROM o JOIN b USING (k)), l AS (SELECT k, beta, sxx, u*u AS g0, u*lag(u,1) OVER w AS g1, u*lag(u,2) OVER w AS g2, u*lag(u,3) OVER w AS g3 FROM u WINDOW w AS (PARTITION BY k ORDER BY s)) SELECT k, round(any_value(beta)*any_value(sxx)/sqrt(sum(g0)+2*(0.75*sum(g1)+0.5*sum(g2)+0.25*sum(g3))), 6) AS t FROM l GROUP BY k"))
def nw_t(spark, sf):
    """Slope t with Bartlett weights over three lags."""
    g, w = Window.partitionBy("k"), R.ordered(["k"])
    o = pairs(spark, sf).select("k", "s", (F.col("x") - F.avg("x").over(g)).alias("xc"), (F.col("y") - F.avg("y").over(g)).alias("yc"))
    b = o.groupBy("k").agg((F.sum(F.col("xc") * F.col("yc")) / F.sum(F.col("xc") * F.col("xc"))).alias("beta"), F.sum(F.col("xc") * F.col("xc")).alias("sxx"))
    u = o.join(b, "k").withColumn("u", F.col("xc") * (F.col("yc") - F.col("beta") * F.col("xc")))
    lags = u.select("k", "beta", "sxx", *[(F.col("u") * (F.lag("u", i).over(w) if i else F.col("u"))).alias(f"g{i}") for i in range(4)])
    v = F.sum("g0") + 2 * sum(((1 - i / 4) * F.sum(f"g{i}") for i in (1, 2, 3)), F.lit(0.0))
    return lags.groupBy("k").agg(F.round(F.first("beta") * F.first("sxx") / F.sqrt(v), 6).alias("t"))


P_SQL = ", pv AS (SELECT c_custkey AS id, c_nationkey AS g, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM customer)"


@query("bh_q", f"WITH x AS (SELECT 1) {P_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1 AS r, count(*) OVER (PARTITION BY g) AS m FROM pv) SELECT id, g, least(1.0::DOUBLE, min(p * m / r) OVER (PARTITION BY g ORDER BY r DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r")
def bh_q(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), (F.col("c_custkey") * 7919 % 1000 / F.lit(1000.0)).alias("p"))
    return S.adjusted_q(p, "p", ["g"]).select("id", "g", "q")


@query("quintiles", with_base(f"{PAIRS}, e AS (SELECT k, quantile_cont(x::DOUBLE, [0.2,0.4,0.6,0.8]) AS q FROM fac GROUP BY k), b AS (SELECT fac.k, y, 1 + len(list_filter(q, lambda v: fac.x > v)) AS b FROM fac JOIN e USING (k)) SELECT k, b AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) / count(*) AS mean_y FROM b GROUP BY k, b"))
def quintiles(spark, sf):
    f = pairs(spark, sf)
    e = f.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(v) for v in (0.2, 0.4, 0.6, 0.8)])).alias("q"))
    b = f.join(e, "k").withColumn("bin", (1 + F.size(F.filter("q", lambda v: F.col("x") > v))).cast("long"))
    return b.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), (F.sum("y") / F.count(F.lit(1))).alias("mean_y"))


@query("forecast_metrics", with_base(", f AS (SELECT s, x - lag(x, 1) OVER (ORDER BY s) AS p, lead(x, 1) OVER (ORDER BY s) - x AS y FROM lvl), g AS (SELECT * FROM f WHERE p IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS n, CAST(sum(abs(p-y)) AS BIGINT) / count(*) AS mae, round(avg(((p-y)*(p-y))::DOUBLE), 4) AS mse, count(*) FILTER (p <> 0 AND y <> 0) AS direction_n, count(*) FILTER (p*y > 0) AS correct, count(*) FILTER (p > 0 AND y > 0) / nullif(count(*) FILTER (p <> 0 AND y > 0), 0) AS up_recall, count(*) FILTER (p < 0 AND y < 0) / nullif(count(*) FILTER (p <> 0 AND y < 0), 0) AS down_recall FROM g"))
def forecast(spark, sf):
    w = R.ordered([])
    f = level(spark, sf).select((F.col("x") - F.lag("x").over(w)).alias("p"), (F.lead("x").over(w) - F.col("x")).alias("y"))
    m = S.forecast_metrics(F.col("p"), F.col("y"))
    m["mse"] = F.round(m["mse"], 4)
    return f.agg(*[c.alias(n) for n, c in m.items()])


@query("calibration", with_base(", f AS (SELECT (s * 37 % 101) / 101.0::DOUBLE AS p, CASE WHEN lead(x) OVER (ORDER BY s) > x THEN 1 ELSE 0 END AS y FROM lvl) SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, CAST(sum(y) AS BIGINT) / count(*) AS rate, round(avg((p-y)*(p-y)), 8) AS brier FROM f GROUP BY 1"))
def calibration(spark, sf):
    f = level(spark, sf).select((F.col("s") * 37 % 101 / F.lit(101.0)).alias("p"), F.coalesce((F.lead("x").over(R.ordered([])) > F.col("x")).cast("int"), F.lit(0)).alias("y"))
    bin_ = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")
    return f.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 8).alias("mean_p"), (F.sum("y") / F.count(F.lit(1))).alias("rate"), F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 8).alias("brier"))


@query("auc", with_base(", f AS (SELECT year(d) AS yr, x AS p, CASE WHEN lead(x) OVER (ORDER BY s) > x THEN 1 ELSE 0 END AS y FROM lvl), r AS (SELECT yr, y, rank() OVER (PARTITION BY yr ORDER BY p) + (count(*) OVER (PARTITION BY yr, p) - 1) / 2.0::DOUBLE AS r FROM f) SELECT yr, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM r GROUP BY yr"))
def auc(spark, sf):
    f = level(spark, sf).select(F.year("d").cast("long").alias("yr"), F.col("x").alias("p"), F.coalesce((F.lead("x").over(R.ordered([])) > F.col("x")).cast("int"), F.lit(0)).alias("y"))
    r = f.withColumn("r", R.average_rank(F.col("p"), ["yr"]))
    up, down = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return r.groupBy("yr").agg(((F.sum(F.when(F.col("y") == 1, F.col("r"))) - up * (up + 1) / 2) / F.nullif(up * down, F.lit(0))).alias("auc"))


@query("equity_metrics", with_base(", p AS (SELECT year(d) AS yr, s, x - lag(x) OVER (ORDER BY s) AS g FROM lvl), e AS (SELECT yr, s, coalesce(g, 0) AS g, CAST(sum(coalesce(g, 0)) OVER (PARTITION BY yr ORDER BY s) AS BIGINT) AS eq FROM p), m AS (SELECT yr, g, eq, greatest(0, max(eq) OVER (PARTITION BY yr ORDER BY s ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e) SELECT yr, CAST(sum(g) AS BIGINT) AS total, CAST(max(dd) AS BIGINT) AS max_drawdown, count(*) FILTER (g > 0) AS up_days, count(*) FILTER (g < 0) AS down_days FROM m GROUP BY yr"))
def equity(spark, sf):
    """Per year: profit rebased to 0, and the deepest fall from its running maximum, 0 included."""
    w = R.ordered(["yr"]).rowsBetween(Window.unboundedPreceding, 0)
    p = level(spark, sf).select(F.year("d").cast("long").alias("yr"), "s", F.coalesce(F.col("x") - F.lag("x").over(R.ordered([])), F.lit(0)).alias("g"))
    e = p.withColumn("eq", F.sum("g").over(w))
    m = e.withColumn("dd", F.greatest(F.lit(0), F.max("eq").over(w)) - F.col("eq"))
    return m.groupBy("yr").agg(F.sum("g").alias("total"), F.max("dd").alias("max_drawdown"), F.count_if(F.col("g") > 0).alias("up_days"), F.count_if(F.col("g") < 0).alias("down_days"))


@query("month_by_side", "SELECT month(o_orderdate) AS m, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def month_by_side(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O", "P"))
    return o.groupBy(F.month("o_orderdate").cast("long").alias("m")).pivot("o_orderstatus", ["F", "O"]).count().select("m", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("concentration", "WITH r AS (SELECT c_nationkey AS g, CAST(round(c_acctbal*100) AS BIGINT) AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT g, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v) FILTER (n <= 3 AND v > 0) AS BIGINT) AS top3, CAST(sum(v) - sum(v) FILTER (n <= 3 AND v > 0) AS BIGINT) AS after FROM r GROUP BY g")
def concentration(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.round(F.col("c_acctbal") * 100).cast("long").alias("v"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("n"))
    top = F.sum(F.when((F.col("n") <= 3) & (F.col("v") > 0), F.col("v")))
    return c.groupBy("g").agg(F.sum("v").alias("total"), top.alias("top3"), (F.sum("v") - top).alias("after"))


@query("wilson_ci", with_base(", h AS (SELECT k, count(*) FILTER (st = 'F') AS a, count(*) AS n FROM ord GROUP BY k), p AS (SELECT k, a / n AS p, 3.8416::DOUBLE / n AS z, n FROM h) SELECT k, round((p + z/2)/(1+z) - 1.96*sqrt(p*(1-p)/n + z/(4*n))/(1+z), 10) AS low, round((p + z/2)/(1+z) + 1.96*sqrt(p*(1-p)/n + z/(4*n))/(1+z), 10) AS high FROM p"))
def wilson_ci(spark, sf):
    h = orders_by_day(spark, sf).groupBy("k").agg(F.count_if(F.col("st") == "F").alias("a"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("a"), F.col("n"))
    return h.select("k", F.round(low, 10).alias("low"), F.round(high, 10).alias("high"))


CDF = "CASE WHEN {x} >= 0 THEN 1 - exp(-({x})*({x})/2)/2.5066282746310002::DOUBLE*{t} ELSE exp(-({x})*({x})/2)/2.5066282746310002::DOUBLE*{t} END"


def _cdf(x):
    t = f"(1/(1+0.2316419::DOUBLE*abs({x})))"
    poly = "0.0::DOUBLE"
    for c in ("1.330274429", "-1.821255978", "1.781477937", "-0.356563782", "0.319381530"):
        poly = f"(({poly} + {c}::DOUBLE) * {t})"
    return CDF.format(x=x, t=poly)


@query("black76_put", f"WITH p AS (SELECT p_partkey, p_retailprice AS f, p_retailprice * (0.8::DOUBLE + (p_partkey % 5) / 10.0::DOUBLE) AS k, 0.2::DOUBLE AS v, p_size / 50.0::DOUBLE AS t FROM part), d AS (SELECT *, ln(f/k)/(v*sqrt(t)) + v*sqrt(t)/2 AS d1, ln(f/k)/(v*sqrt(t)) - v*sqrt(t)/2 AS d2 FROM p) SELECT p_partkey, round(k * ({_cdf('-d2')}) - f * ({_cdf('-d1')}), 6) AS price, round(-({_cdf('-d1')}), 8) AS delta, round({_cdf('-d2')}, 8) AS exercise FROM d")
def black76_put(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("f"), (F.col("p_retailprice") * (F.lit(0.8) + F.col("p_partkey") % 5 / F.lit(10.0))).alias("k"), (F.col("p_size") / F.lit(50.0)).alias("t"))
    out = black_put(F.col("f"), F.col("k"), F.lit(0.2), F.col("t"))
    return p.select("p_partkey", F.round(out["price"], 6).alias("price"), F.round(out["delta"], 8).alias("delta"), F.round(out["exercise"], 8).alias("exercise"))


@query("normal_cdf", f"SELECT c_custkey, round({_cdf('(c_acctbal/3000)')}, 8) AS p FROM customer")
def normal(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(normal_cdf(F.col("c_acctbal") / 3000), 8).alias("p"))


def signals(spark, sf):
    """Level with the sign of its last change, one strategy per phase."""
    lv = level(spark, sf).select("s", F.col("x").alias("level"), F.signum((F.col("x") - F.lag("x").over(R.ordered([]))).cast("double")).cast("int").alias("signal"))
    return lv.crossJoin(F.broadcast(spark.range(2).select(F.col("id").alias("phase")))).withColumn("signal", F.when((F.col("s") + F.col("phase")) % 3 == 0, F.lit(0)).otherwise(F.col("signal")))


@query("sim_fixed", "WITH RECURSIVE " + with_base("").strip()[5:] + """,
sg AS (SELECT s, x AS level, CAST(coalesce(sign(x - lag(x) OVER (ORDER BY s)), 0) AS INTEGER) AS sig FROM lvl),
ph AS (SELECT s, level, phase, CASE WHEN (s + phase) % 3 = 0 THEN 0 ELSE sig END AS signal, max(s) OVER () AS last FROM sg CROSS JOIN (SELECT unnest([0,1]) AS phase) q),
run AS (
  SELECT phase, s, level, 0 AS position, 0::BIGINT AS daily_pnl, 0::BIGINT AS equity, '' AS reason, CASE WHEN s < last THEN signal ELSE 0 END AS held, 0 AS age FROM ph WHERE s = 1
  UNION ALL
  SELECT p.phase, p.s, p.level, r.held, r.held * (p.level - r.level), r.equity + r.held * (p.level - r.level),
    CASE WHEN r.held <> 0 AND r.age + 1 >= 6 AND p.s < p.last THEN 'max_hold' ELSE '' END,
    CASE WHEN r.held <> 0 AND r.age + 1 < 6 THEN r.held WHEN p.s < p.last THEN p.signal ELSE 0 END,
    CASE WHEN r.held <> 0 AND r.age + 1 < 6 THEN r.age + 1 ELSE 0 END
  FROM run r JOIN ph p ON p.phase = r.phase AND p.s = r.s + 1)
SELECT CAST(phase AS BIGINT) AS phase, s, CAST(position AS INTEGER) AS position, daily_pnl::DOUBLE AS daily_pnl, equity::DOUBLE AS equity, reason FROM run""")
def sim_fixed(spark, sf):
    return simulate(signals(spark, sf), ["phase"], hold=6).select("phase", "s", "position", "daily_pnl", "equity", "reason")
